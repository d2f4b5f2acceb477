import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tabloom.llm.packing import encoder, first_fit_decreasing, pack
from tabloom.llm.common import components
from tabloom.llm.simhash import bucket_links, near_duplicates
from tabloom.llm.suffixes import remove_repeats

SCHEMA = "doc_id long, text string, uid string, lead string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 3, 5, 40, 150, 300]))) for _ in range(n)]
    passage = " ".join(rnd.choice(words) for _ in range(70))
    for i in range(0, n, 4):
        w = texts[i].split()
        texts[i] = " ".join([*w[: len(w) // 2], passage, *w[len(w) // 2 :]])
    for i in range(1, n, 9):
        w = texts[i - 1].split() or ["q"]
        w[rnd.randrange(len(w))] = "edited"
        texts[i] = " ".join(w)
    texts += [None, "", " \t ", texts[0], texts[0], "a" * 900, "ab" * 450, "x" * 199, "x" * 200]
    return list(enumerate(texts))


def test_tournament_tree_is_first_fit():
    rnd = random.Random(3)
    sizes = sorted((rnd.randint(1, 100) for _ in range(300)), reverse=True)
    bins, offsets = first_fit_decreasing(np.array(sizes), 100)
    free = []
    for s, b, o in zip(sizes, bins, offsets):
        want = next((i for i, f in enumerate(free) if f >= s), len(free))
        if want == len(free):
            free.append(100)
        assert (b, o) == (want, 100 - free[want])
        free[want] -= s


def test_fast_encoder_gives_the_same_ids():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["Hello  world\n\n x", "", "é ñ 漢字 🙂", "a<|endoftext|>b", "don't  stop\t1234", " " * 50 + "z" * 500]
    rnd = random.Random(12)
    kinds = ["abc de", " \t\n\r", "0123,.", "'sdtllvemre", "éßñ\u00a0\u2028", "漢字かな", "🙂👩‍👩‍👧", "<|endoftext|>", "\u0301\u200d\ufeff"]
    texts += ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert encoder("byte_bpe_50k.json")(texts) == [e.ids for e in full.encode_batch(texts, add_special_tokens=False)]


def test_pack_covers_every_id_once(spark):
    rows = [(i, t) for i, t in corpus()] + [(5, "again"), (None, "no id"), (900, "word " * 5000)]
    got = [r for r in pack(frame(spark, rows)).collect() if r.doc_id is not None and r.doc_id != 5]
    encode, by_doc, by_seq = encoder("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in rows:
        if i in (None, 5):
            continue
        ids = np.array(encode([text or ""])[0] + [0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    full = defaultdict(list)
    for r in pack(frame(spark, rows)).collect():
        full[r.sequence_id].append((r.offset, r.length))
    for seq in full.values():
        at = 0
        for o, n in sorted(seq):
            assert o == at
            at += n
        assert at <= 1024
    assert pack(frame(spark, [])).count() == 0


def brute_simhash(rows):
    def fp(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [(i, fp(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (f"{f:016x}", find(i)) for i, f in fps}


@pytest.mark.parametrize("share", [50_000, 3])
def test_simhash_matches_brute_force(spark, monkeypatch, share):
    import tabloom.llm.simhash as simhash

    monkeypatch.setattr(simhash, "SHARE", share)
    rnd = random.Random(4)
    base = " ".join(f"w{rnd.randrange(500)}" for _ in range(900))
    rows = corpus(5)
    for k in range(60):
        w = base.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(40)}"
        rows.append((1000 + k, " ".join(w)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_simhash(rows)
    assert near_duplicates(frame(spark, [])).count() == 0
    assert near_duplicates(frame(spark, [(1, "a"), (1, "a"), (2, None)])).count() == 3


@pytest.mark.parametrize("share", [64, 4])
def test_no_task_gets_a_hot_value_whole(spark, monkeypatch, share):
    import tabloom.llm.simhash as simhash

    # 4,096 fingerprints that differ in 12 bits alone, so some index value is shared by very many
    rng = np.random.default_rng(1)
    spots = rng.choice(64, 12, replace=False)
    fps = [sum(((k >> i) & 1) << int(s) for i, s in enumerate(spots)) for k in range(4096)]
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    classes = spark.createDataFrame([(x,) for x in fps], "fp long")
    whole = max(r["count"] for r in simhash.dealt(classes)[0].groupBy("key").count().collect())
    monkeypatch.setattr(simhash, "SHARE", share)
    parts = [r["count"] for r in simhash.dealt(classes)[0].groupBy("key").count().collect()]
    assert max(parts) <= whole / 2
    assert components(simhash.links(classes)).count() == 4095  # the cube is one component


def test_bucket_links_span_all_links():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = np.unique(np.concatenate([c ^ (1 << rng.integers(0, 60, (80, 2))).sum(axis=1) for c in centre]))
    for small in (4, 1000):
        a, b = bucket_links(np.zeros(len(fps), np.int64), fps, 3, small)
        assert (np.bitwise_count((a ^ b).view(np.uint64)) <= 3).all()
        names = {int(f): int(f) for f in fps}

        def find(x):
            while names[x] != x:
                x = names[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            names[find(x)] = find(y)
        u = fps.view(np.uint64)
        for i in range(len(u)):
            for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3):
                assert find(int(fps[i])) == find(int(fps[j]))


def brute_repeats(rows, least):
    seen = Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        for p in range(len(b) - least + 1):
            seen[b[p : p + least]] += 1
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                gone[p : p + least] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [200_000, 3])
def test_suffixes_match_brute_force(spark, monkeypatch, hot):
    import tabloom.llm.suffixes as suffixes

    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = corpus(7)
    got = Counter(tuple(r) for r in remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_repeats(rows, 200)
    assert sum(r[2] > 0 for r in got) > 10


def test_suffixes_edges(spark):
    text = corpus(9)[4][1] * 2
    rows = [(1, text), (1, text), (None, text), (3, "short"), (4, None)]
    got = Counter(tuple(r) for r in remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_repeats(rows, 200)
    assert remove_repeats(frame(spark, [])).count() == 0
