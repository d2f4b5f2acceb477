import random

from corpus_pipeline import simhash

SCHEMA = "doc_id long, text string, n_chars long"


def kept_by_brute_force(rows):
    """Rows (id, text), by increasing id, that stay."""

    def grams(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if (not a and not b) or len(a & b) * 5 >= 4 * len(a | b) > 0:
                x, y = sorted((find(i), find(j)))
                root[y] = x
                links += a != b
    return [rows[i] for i in range(len(rows)) if find(i) == i], links


def planted(seed=11):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    line = " ".join(rnd.choice(words) for _ in range(30))
    texts = []
    for k in range(120):
        w = [rnd.choice(words) for _ in range(rnd.choice([1, 4, 5, 6, 9, 60, 150, 400]))]
        if k % 3 == 0:
            w += line.split()
        texts.append(" ".join(w))
        # edits of a word in 30 to 130: five-word similarities on both sides of 0.8
        for _ in range(rnd.randint(0, 4)):
            v = list(w)
            for _ in range(len(w) // rnd.randint(30, 130)):
                at = rnd.randrange(len(v))
                v[at : at + rnd.randint(0, 1)] = [rnd.choice(words)]
            texts.append(" ".join(v))
    family = [rnd.choice(words) for _ in range(90)]
    for _ in range(40):
        v = list(family)
        for _ in range(rnd.randint(0, 4)):
            v[rnd.randrange(len(v))] = rnd.choice(words)
        texts.append(" ".join(v))
    texts += [None, "", " \t", "a", "A ", texts[0], texts[-1].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_match_brute_force(spark, monkeypatch):
    import tabloom.llm.copies as module

    rows = planted()
    want, links = kept_by_brute_force(rows)
    assert links > 100 and len(want) < len(rows) - 60
    monkeypatch.setattr(module, "PACK", 1000)
    for leaders in (4, 1):
        monkeypatch.setattr(module, "LEADERS", leaders)
        frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], SCHEMA).repartition(5)
        got = sorted((r.doc_id, r.text) for r in simhash(spark, frame, "").collect())
        assert got == sorted(want)
    assert simhash(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
