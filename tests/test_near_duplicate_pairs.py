from tabloom.dataset import ROW
from tabloom.operators.rules import near_duplicates
from tabloom.sources.files import from_text


def test_typos_far_apart_in_both_orders(spark):
    # a typo at each end of the text, and over eight rows between the two in either order
    names = ["abcdefghijklmnopqrstuvwxy", "zbcdefghijklmnopqrstuvwxa"]
    names += [f"{a}{a * 7}{chr(97 + k)}{a * 3}{z}" for k, a in enumerate("bcdefghijklmnopqrst") for z in [chr(100 + k)]]
    # each row twice: a column of distinct values alone would be an identifier, which is no evidence of typos
    data = from_text(spark, "Name,City\n" + "".join(f"{n},zzz\n" * 2 for n in names))
    assert {r[ROW]: r.cluster for r in near_duplicates(data).collect()} == {0: 0, 2: 0}
    assert near_duplicates(data, all_pairs=0).count() == 0
