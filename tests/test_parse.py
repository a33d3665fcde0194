"""Golden parser cases (FIXTURES.md §5) and archive scan guards."""

import os

import pytest

from quire.operators.parse import good_rows, parse_articles
from quire.sources.archive import scan_archive

CASES = [
    ("c1.txt", b"Title: A\nAuthor: B\n---\nx\ny"),
    ("c2.txt", b"Title: A: B\n---\nx"),
    ("c3.txt", b"TITLE :  A  \n---\nx"),
    ("c4.txt", b"Title: A\nTitle: B\n---\nx"),
    ("c5.txt", b"Title:\n---\nx"),
    ("c6.txt", b"no colon\n---\nx"),
    ("c7.txt", b"Title: A\nbody"),
    ("c8.txt", b"---\na\n  ---  \nb"),
    ("c9.txt", b"Title: A\r\n---\r\nx"),
    ("c10.txt", b"\xff\xfe"),
    ("c11.txt", b"  \n\t "),
    ("a_20061117_b.txt", b"x"),
    ("a_20061117.txt", b"x"),
    ("20061117_20070101_x.txt", b"x"),
    ("a_20061399_b.txt", b"x"),
    ("d_20061117_e.txt", b"Date: 1 May 2010\n---\nz"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    raw = spark.createDataFrame([("p/" + n, n, c) for n, c in CASES],
                                "path string, filename string, content binary")
    out = {}
    for policy in ("text", "importer"):
        rows = parse_articles(raw, policy).collect()
        out[policy] = {r["filename"]: r for r in rows}
    return out


def test_header_and_body(parsed):
    t = parsed["text"]
    assert t["c1.txt"]["header"] == {"title": "A", "author": "B"} and t["c1.txt"]["content"] == "x\ny"
    assert t["c2.txt"]["title"] == "A: B"
    assert t["c3.txt"]["header"] == {"title": "A"}
    assert t["c4.txt"]["title"] == "B"
    assert t["c5.txt"]["title"] == ""
    assert t["c6.txt"]["header"] == {} and t["c6.txt"]["content"] == "x"
    assert t["c7.txt"]["title"] == "A" and t["c7.txt"]["content"] == ""
    assert t["c8.txt"]["content"] == "a\nb"
    assert t["c9.txt"]["title"] == "A" and t["c9.txt"]["content"] == "x"


def test_errors_and_blank(parsed):
    assert parsed["text"]["c10.txt"]["error"] is not None
    assert "c11.txt" not in parsed["text"]          # dropped by the services
    assert parsed["importer"]["c11.txt"]["error"] is None   # kept by the importer


def test_defaults(parsed):
    t = parsed["text"]
    assert t["c6.txt"]["title"] == "c6" and t["c6.txt"]["author"] == "Unknown"
    assert t["c6.txt"]["source"] == "archive"


def test_file_name_dates(parsed):
    t, i = parsed["text"], parsed["importer"]
    assert t["a_20061117_b.txt"]["publish_date_raw"] == "2006-11-17"
    assert t["a_20061117.txt"]["publish_date_raw"] is None
    assert t["20061117_20070101_x.txt"]["publish_date_raw"] == "2006-11-17"
    assert t["a_20061399_b.txt"]["publish_date_raw"] == "2006-13-99" and t["a_20061399_b.txt"]["error"] is None
    assert "does not match format" in i["a_20061399_b.txt"]["error"]
    assert t["d_20061117_e.txt"]["publish_date_raw"] == "1 May 2010"
    assert str(i["d_20061117_e.txt"]["publish_date"]) == "2006-11-17 00:00:00"


def test_good_rows_schema(spark, parsed):
    raw = spark.createDataFrame([("p/x.txt", "x.txt", b"Title: T\n---\nbody")],
                                "path string, filename string, content binary")
    g = good_rows(parse_articles(raw)).collect()
    assert len(g) == 1 and g[0]["title"] == "T"


def test_scan_archive(spark, scratch):
    df, problem = scan_archive(spark, os.path.join(scratch, "missing"))
    assert problem and df.count() == 0
    os.makedirs(os.path.join(scratch, "empty"))
    df, problem = scan_archive(spark, os.path.join(scratch, "empty"))
    assert "No .txt" in problem and df.count() == 0
    folder = os.path.join(scratch, "arch")
    os.makedirs(os.path.join(folder, "sub"))
    for name, body in [("a_20061117_b.txt", "Title: A\n---\nx"), ("x.TXT", "no"), ("notes.md", "no"),
                       ("sp ace.txt", "---\ny")]:
        with open(os.path.join(folder, name), "w") as f:
            f.write(body)
    with open(os.path.join(folder, "sub", "deep.txt"), "w") as f:
        f.write("deep")
    df, problem = scan_archive(spark, folder)
    assert problem is None
    assert sorted(r["filename"] for r in df.collect()) == ["a_20061117_b.txt", "sp ace.txt"]


def test_folder_with_glob_characters_and_nested_names(spark, scratch):
    folder = os.path.join(scratch, "a[1] {x}*")
    os.makedirs(os.path.join(folder, "d.txt"))
    for name in ("one.txt", "two.md", "d.txt/in.txt"):
        with open(os.path.join(folder, name), "w") as f:
            f.write("---\nbody")
    df, problem = scan_archive(spark, folder)
    assert problem is None and [r["filename"] for r in df.collect()] == ["one.txt"]
