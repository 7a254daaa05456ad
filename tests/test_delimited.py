"""Encodings and limits of delimited files."""

import pytest

from statloom.sources.tables import read_delimited, text_form


@pytest.mark.parametrize(
    ("encoding", "word", "told"),
    [("utf-8", "né", "UTF-8"), ("utf-8-sig", "né", "UTF-8"), ("cp1252", "né – €", "windows-1252"), ("latin-1", "né \x81", "ISO-8859-1"), ("ascii", "ne", "UTF-8")],
)
def test_encoding_is_decided_on_the_whole_file(spark, tmp_path, encoding, word, told):
    path = tmp_path / "far.csv"  # the telling word comes after 5,000 plain lines
    path.write_bytes(("age;city\n" + "31,5;Lyon\n" * 5000 + f"44,5;{word}\n").encode(encoding))
    assert text_form(spark, str(path)) == (told, 5002)
    df = read_delimited(spark, str(path))
    assert df.columns == ["age", "city"] and dict(df.dtypes)["age"] == "double"
    assert [(r["age"], r["city"]) for r in df.where("age > 40").collect()] == [(44.5, word)]


def test_limits_count_rows_and_cells(spark, tmp_path):
    path = tmp_path / "small.csv"
    path.write_text("a,b,c\n" + "1,2,3\n" * 10)
    assert read_delimited(spark, str(path), 10, 30).count() == 10
    with pytest.raises(ValueError, match="9 rows"):
        read_delimited(spark, str(path), 9)
    with pytest.raises(ValueError, match="29 cells"):
        read_delimited(spark, str(path), None, 29)
    wide = tmp_path / "wide.csv"
    wide.write_text(";".join(f"v{k}" for k in range(2001)) + "\n")
    with pytest.raises(ValueError, match="2000 columns"):
        read_delimited(spark, str(wide))


def test_an_empty_file_is_utf8(spark, tmp_path):
    path = tmp_path / "none.csv"
    path.write_text("")
    assert text_form(spark, str(path)) == ("UTF-8", 0)
