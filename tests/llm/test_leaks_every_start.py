import random
import re
from collections import Counter

from tabloom.llm.decontaminate import leaks


def best_of_every_start(docs, items):
    def shingles(w):
        return Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    def like(a, b):
        total = lambda c: sum(len(s.replace(" ", "")) * n for s, n in c.items())
        low = total(a & b)
        return low / max(1, total(a) + total(b) - low)

    out, between = {}, 0
    for d, t in docs:
        w = re.findall(r"[^\W_]+", t.lower())
        for k, x in items:
            v = x.split()
            here = {s: like(shingles(w[s : s + len(v)]), shingles(v)) for s in range(max(1, len(w) - len(v) + 1))}
            same = {max(0, min(i - j, len(w) - len(v))) for i in range(len(w) - 4) for j in range(len(v) - 4) if w[i : i + 5] == v[j : j + 5]}
            best = max((here[s] for s in same), default=0)
            between += best < 0.8 <= max(here.values())
            best = best if best >= 0.8 else max(here.values())
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out, between


def test_windows_between_alignments(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([1, 2, 3, 9, 14]))) for _ in range(300)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([12, 17, 30])))) for k in range(30)]
    docs = []
    for d in range(400):
        passage = items[d % 30][1].split()
        for _ in range(rnd.randint(1, 2)):
            at = rnd.randrange(len(passage))
            passage[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["q"], ["extraordinarily"]])
        body = [rnd.choice(words) for _ in range(rnd.choice([0, 30, 80]))]
        half = rnd.randint(0, len(body))
        docs.append((d, " ".join([*body[:half], *passage * rnd.choice([1, 1, 3]), *body[half:]])))
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, between = best_of_every_start(docs, items)
    assert got == want and len(got) > 50 and between >= 3
