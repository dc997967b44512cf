"""Licenses stand in runs of words: English prose with a template's words far apart has none."""

from helixframe.llm import licenses

PROSE = "the man of the house went to the town and in a day or so he is to see if this is for the use of any of you "


def test_prose_has_no_license(spark):
    far = lambda *words: " ".join(PROSE * 40 + w for w in words)
    notice = "Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated\n * documentation files"
    texts = {
        1: far("copyright", "all", "rights", "reserved"),
        2: "he went to study at MIT under the name of his father and the driving license was void until it was released in the spring",
        3: "a shop for cc cards is by the nc road, open from 4 to 9 and closed at 0 hours; it was licensed in the year under review",
        4: PROSE * 60 + notice + " " + PROSE * 60,
        5: PROSE * 3 + "Copyright (c) 2020 J. Doe. All rights reserved. " + PROSE * 3,
        6: "released under the MIT license",
        7: far("licensed", "under", "cc by nc", "4 0"),
        8: "licensed under cc by-nc 4.0 " * 3,
        9: PROSE * 400,
        10: "copyright " + "x " * 6 + "all rights reserved " + "y " * 50 + "copyright all",
        11: "copyright x x x x x all rights reserved",
    }
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k for k, (labels, _) in got.items() if not labels} == {1, 2, 3, 9, 10, 11}
    assert got[4] == ("mit", 1.0) and got[5] == ("proprietary", 1.0) and got[6] == ("mit", 1.0)
    assert got[8][0] == "cc-by,cc-by-nc" and got[7][0] == "cc-by"
