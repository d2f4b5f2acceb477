import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabloom.llm.chat import rotate
from tabloom.llm.decontaminate import leaks
from tabloom.llm.fingerprints import fingerprint
from tabloom.llm.langid import identify
from tabloom.llm.licenses import LICENSES, scan
from tabloom.llm.lines import repeated_units
from tabloom.llm.quality import score_quality

DOCS = "doc_id long, text string, lang string, n long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "k") for i, t, g in rows], DOCS)


def prose(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_rows(spark):
    rnd = random.Random(1)
    kinds = {"aa": ["lo", "mi", "ta"], "bb": ["schr", "ung", "ö"], "cc": ["eau", "ç", "ri"]}
    rows = [(i, prose(rnd, kinds[g], 40), g) for i, g in enumerate(list(kinds) * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 -- 34", None), (903, rows[0][1] * 300, "aa"), (None, "lo mi", "aa"), (5, rows[5][1], rows[5][2])]
    got = identify(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    truth = {i: g for i, _, g in rows[:180]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902}
    assert identify(frame(spark, [])).count() == 0


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rnd, ["ka", "to", "mer", "sil"], 60)
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t, "aa"))
        labels.append((i, int(not bad), 9))
    rows += [(900, None, None), (901, "", None), (None, "ka to", None)]
    labels += [(None, 1, 0), (3, None, 0), (7, 7, 0)]
    got = score_quality(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, text long")).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all((r.predicted == 1) == (r.doc_id % 4 != 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = score_quality(frame(spark, rows[:3]), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r.score for r in none] == [0.5] * 3


def brute_leaks(docs, items):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def shingles(w):
        return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    def like(a, b):
        weight = lambda s: len(s.replace(" ", ""))
        low = sum(weight(s) * min(a[s], b[s]) for s in a.keys() & b.keys())
        full = sum(weight(s) * n for s, n in a.items()) + sum(weight(s) * n for s, n in b.items())
        return low / max(1, full - low)

    out = {}
    for d, t in docs:
        w = words(t)
        for k, x in items:
            v = words(x)
            size = min(5, len(v)) if len(v) >= 5 else 1
            aligned = {i - j for i in range(len(w) - size + 1) for j in range(len(v) - size + 1 if size == 5 else min(1, len(v))) if w[i : i + size] == v[j : j + size]}
            starts = {max(0, min(s, len(w) - len(v))) if size == 5 else s for s in aligned}
            best = max((like(shingles(w[s : s + len(v)]), shingles(v)) for s in starts), default=0)
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out


@pytest.mark.parametrize("bound", [50_000, 0])
def test_leaks_match_brute_force(spark, monkeypatch, bound):
    import tabloom.llm.decontaminate as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", bound)
    rnd = random.Random(3)
    items = [(k, prose(rnd, ["ba", "di", "ko", "fu", "re", "ly"], rnd.choice([15, 25, 40]))) for k in range(8)] + [(50, None), (51, ""), (52, "uno dos tres")]
    docs = []
    for i in range(40):
        body = prose(rnd, ["ba", "di", "ko", "fu", "re", "ly"], 60).split()
        if i % 2:
            passage = items[i % 8][1].split()
            if i % 6 == 3:
                passage[rnd.choice([0, len(passage) - 1])] = "changed"
            body[20:20] = [p.upper() if i % 5 == 1 else p + "," for p in passage]
        docs.append((i, " ".join(body), None))
    docs += [(100, None, None), (101, "", None), (102, items[0][1], None), (102, items[0][1], None), (103, "so uno, dos TRES", None)]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks([(i, t) for i, t, _ in docs], items)
    assert got == want and len(want) > 15
    assert leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def pieces(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def leaf_texts(text):
    """What the leaves and the opening words of a text hold; their digests stand for these."""
    leaves = {("leaf", x) for p in pieces(text) for x in re.findall(r"\s*\S+(?:[ \t]+\S+)?\s*|\s+", p)}
    return leaves | {("word", x) for x in re.split(r"\s+", text.split("\n")[0].strip(" "))[:8] if x}


def alike(a, b):
    x, y = leaf_texts(a), leaf_texts(b)
    return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def first_edited(a, b):
    """Place of the first paragraph that differs, in the first section that does."""
    if a == b:
        return 0
    at = 0
    split = lambda t: re.findall(r"(?s).+?(?:\n[ \t\r]*\n\s*|\Z)", t)
    x, y = split(a), split(b)
    for k in range(max(len(x), len(y))):
        p, q = pieces(x[k] if k < len(x) else ""), pieces(y[k] if k < len(y) else "")
        if p != q:
            return at + next(i for i in range(max(len(p), len(q))) if p[i : i + 1] != q[i : i + 1]) + 1
        at += len(p)


def test_fingerprints(spark, monkeypatch):
    import tabloom.llm.fingerprints as module

    monkeypatch.setattr(module, "BUCKET_BYTES", 500)
    rnd = random.Random(5)
    rows = [(i * 3, prose(rnd, ["ba", "é", "ko"], rnd.choice([1, 8, 80])) + "\n" * (i % 3) + "x", None) for i in range(60)] + [(7, None, None), (8, "", None), (10, "a\n\nb\nc\n\n\nd e f g h\n", None), (11, "a\n\nb\nx y z\n\nq\n\nrrr s\n", None), (200, "same\n\nsame", None), (201, "same\n\nsame", None)]
    ordered = sorted((i, t or "") for i, t, _ in rows)
    got = {r.doc_id: r for r in fingerprint(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for text, p in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(text, p) == p
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert r.first_edited_paragraph == first_edited(t, edited)
        assert round(r.near_edited, 9) == round(alike(t, edited), 9) and round(r.near_next, 9) == round(alike(t, nxt), 9)
    assert len(set(prints.values())) == len(prints)
    assert got[200].near_next == 1.0
    single = fingerprint(frame(spark, [(1, "abcd", None)])).first()
    assert single.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint(frame(spark, [])).count() == 0
    assert fingerprint(frame(spark, [(None, "a b", None), (1, "c", None), (1, "c", None)])).count() == 3


def test_licenses(spark):
    mit = LICENSES["MIT"].replace("<year> <holder>", "1999 Someone Else, Inc.")
    rows = [(1, mit.upper(), None), (2, mit.replace("\n\n", "\n \n").replace("sublicense", "sub-license"), None), (3, mit + " and more", None), (4, None, None), (5, "", None), (1, mit, None)]
    got = Counter((r.doc_id, r.license) for r in scan(frame(spark, rows)).collect())
    assert got == Counter({(1, "MIT"): 2, (2, "MIT"): 1, (3, None): 1, (4, None): 1, (5, None): 1})
    assert scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("salts", [64, 3])
def test_lines_match_brute_force(spark, monkeypatch, salts):
    import tabloom.llm.lines as module

    monkeypatch.setattr(module, "SALTS", salts)
    rnd = random.Random(6)
    lines = [prose(rnd, ["ba", "É", "ko"], 15) for _ in range(12)] + ["short", "", "  "]
    rows = [(i, "\n".join(rnd.choice(lines).upper() if rnd.random() < 0.3 else rnd.choice(lines) for _ in range(rnd.randint(0, 6))), None) for i in range(30)] + [(90, None, None), (91, "", None)]
    # a line in every row, many times over all others; a null id; a long text
    rows += [(200 + i, "the common line\n" * 9, None) for i in range(40)] + [(None, "only here\nshort", None), (300, "\n".join(f"line {k}" for k in range(20_000)), None)]

    def brute(gap, least):
        units = []
        for i, t, _ in rows:
            at = 0
            for k, line in enumerate((t or "").split(gap)):
                plain = re.sub(r"\s+", " ", line.lower()).strip()
                if len(plain) >= least:
                    units.append((plain, i, k, at, at + len(line)))
                at += len(line) + len(gap)
        groups = {}
        for u in units:
            groups.setdefault(u[0], []).append(u[1:])
        first = {p: min(x, key=lambda o: (o[0] is None, o[0] or 0, o[1])) for p, x in groups.items() if len(x) > 1}
        return {(*o, *first[p][:2], o[:2] != first[p][:2]) for p in first for o in groups[p]}

    for unit, gap, least in (("line", "\n", 1), ("line", "\n", 40), ("paragraph", "\n\n", 1)):
        got = [tuple(r[c] for c in ("doc_id", "unit", "start", "end", "kept_doc_id", "kept_unit", "removed")) for r in repeated_units(frame(spark, rows), unit=unit, least_chars=least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(gap, least) and got
    assert repeated_units(frame(spark, [])).count() == 0


def test_lines_of_repeated_ids(spark):
    got = [tuple(r[c] for c in ("doc_id", "unit", "kept_doc_id", "removed")) for r in repeated_units(frame(spark, [(1, "a b", None), (1, "A  B", None), (2, "a b", None)])).collect()]
    assert sorted(got) == [(1, 0, 1, False), (1, 0, 1, False), (2, 0, 1, True)]


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé"), (1, 3, None, None), (2, 0, "system", "only"), (None, 0, "zed", "x")]
    got = rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.position):
        text = whole.get((r.conv_id, r.perspective), "")
        assert r.start == len(text) and r.end == len(text) + len(r.segment)
        assert r.mask == int(r.segment.startswith("<|assistant|>"))
        whole[r.conv_id, r.perspective] = text + r.segment
    assert set(whole) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "zed")}
    assert whole[1, "bob"] == "<|system|>\nrules<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\nhé<|end|>\n<|user name=unknown|>\n<|end|>\n"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    SF = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            sizes.append(docs.count())
        else:
            assert out.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    texts = [r.text or "" for r in docs.collect()]
    windows = Counter(b[p : p + 200] for b in (t.encode() for t in texts) for p in range(0, max(0, len(b) - 199), 1))
    assert np.mean([n > 1 for n in windows.values()] or [0]) < 0.01
