"""Archives are read by need."""

import zipfile

import pytest

from quarrywise.sources import epub, files


@pytest.fixture
def shelf(tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"b{k}.epub", "w") as z:
            z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
            z.writestr("o/c.opf", '<package xmlns="p"><manifest>' + "".join(f'<item id="i{j}" href="{j}.html"/>' for j in range(5)) + "</manifest><spine>" + "".join(f'<itemref idref="i{4 - j}"/>' for j in range(5)) + '<itemref idref="gone"/></spine></package>')
            for j in range(5):
                z.writestr(f"o/{j}.html", f"<h1>Book {k}</h1><p>part {j} of some length</p>")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    return tmp_path


def test_all_documents_of_all_archives(spark, shelf):
    want = {(r.path.split("/")[-1], r.place, r.text, r.problem is None) for r in files.read_epub(spark, str(shelf)).collect()}
    got = epub.read_books(spark, str(shelf)).collect()
    assert {(r.path.split("/")[-1], r.place, r.text, r.problem is None) for r in got} == want and len(got) == 16


def test_conditions_go_down_to_the_reader(spark, shelf):
    """An entry that can't be unpacked is no trouble where its place isn't asked for, nor an archive whose path isn't."""
    raw = bytearray((shelf / "b1.epub").read_bytes())
    at = raw.index(b"part 2 of")
    raw[at : at + 4] = b"BAD!"
    (shelf / "b1.epub").write_bytes(bytes(raw))
    one = epub.read_books(spark, str(shelf), "place = 0 AND problem IS NULL")
    assert sorted((r.path[-7:], r.name) for r in one.collect()) == [(f"b{k}.epub", "o/4.html") for k in range(3)]
    said = spark._jvm.PythonSQLUtils.explainString(epub.read_books(spark, str(shelf), "place = 0")._jdf.queryExecution(), "formatted")
    assert "Filter" not in said.split("BatchScan")[0] or "PushedFilters" in said
    some = epub.read_books(spark, str(shelf), f"path IN ('{shelf}/b0.epub', '{shelf}/b2.epub') AND place >= 3").collect()
    assert sorted((r.path[-7:], r.place) for r in some) == [("b0.epub", 3), ("b0.epub", 4), ("b2.epub", 3), ("b2.epub", 4)]
    broken = epub.read_books(spark, str(shelf)).where("problem IS NOT NULL").collect()
    assert sorted(r.path.split("/")[-1] for r in broken) == ["b1.epub", "bad.epub"]


def test_reader_takes_only_what_it_can(shelf):
    r = epub.EpubReader(str(shelf))
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringContains

    left = list(r.pushFilters([EqualTo(("place",), 1), IsNotNull(("place",)), StringContains(("path",), "b1"), EqualTo(("path",), f"{shelf}/b1.epub")]))
    assert len(left) == 2 and [p.path for p in r.partitions()] == [f"{shelf}/b1.epub"]
    assert [(x[1], x[2]) for x in r.read(r.partitions()[0])] == [(1, "o/3.html")]


def test_an_empty_shelf(spark, tmp_path):
    assert epub.read_books(spark, str(tmp_path)).collect() == []
