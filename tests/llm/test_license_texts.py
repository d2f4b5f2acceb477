import pytest

from tabloom.llm.licenses import known_licenses, scan


def found(spark, texts):
    return [r.license for r in sorted(scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]


def test_every_known_text_in_any_layout(spark):
    names = list(known_licenses())
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Unlicense", "zlib", "BSL-1.0", "CC0-1.0"} <= set(names)
    texts = [known_licenses()[n] for n in names]
    assert found(spark, texts) == names
    assert found(spark, [" ".join(t.split()) for t in texts]) == names


@pytest.mark.parametrize("notice", ["Copyright Jane Doe and contributors", "Copyright (c) 2001-2020 Foo, Inc. and others", "© Jane Doe", "Copyright 2020 J. Doe. All rights reserved.", "Copyright The Foo Authors"])
def test_notices(spark, notice):
    mit = known_licenses()["MIT"].replace("Copyright (c) <year> <holder>", notice)
    assert notice in mit
    assert found(spark, [mit, " ".join(mit.split()), mit.replace(notice + "\n\n", notice + " "), mit.replace("Permission is hereby", "No permission is")]) == ["MIT"] * 3 + [None]
