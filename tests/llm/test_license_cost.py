import re
import time

from tabloom.llm.licenses import NOTICE, known_licenses, scan


def test_a_notice_is_looked_for_behind_copyright_alone():
    # the pattern looks behind by every length it allows; before the word was tested, it did so at every character
    assert re.search(r"\(\?=copyright\)\(\?:\(\?<=", NOTICE)


def test_a_notice_as_long_as_a_document(spark):
    mit = known_licenses()["MIT"].split("Permission", 1)[1]
    holders = ", ".join(f"holder {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, f"MIT License\n\nCopyright (c) 2020 {holders}\n\nPermission{mit}"), (2, holders)], "doc_id long, text string")
    began = time.time()
    assert {r.doc_id: r.license for r in scan(df).collect()} == {1: "MIT", 2: None}
    assert time.time() - began < 60
