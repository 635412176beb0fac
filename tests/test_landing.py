"""Text rows that cannot be read, and extracts from one pass over the signals."""

from signalloom.sources import landing, readers


def test_rows_of_another_width_are_set_apart(spark, tmp_path):
    text = tmp_path / "num.txt"
    text.write_text('adsh\ttag\tvalue\na\t"with\ttab"\t1\nshort\tx\nb\t5" pipe\t2\nlong\tx\t1\t2\nc\t\t3\n')
    good, bad = readers.read_tab_rows(spark, str(text))
    assert good.columns == ["adsh", "tag", "value"]
    assert sorted(map(tuple, good.collect())) == [("a", "with\ttab", "1"), ("b", '5" pipe', "2"), ("c", None, "3")]
    assert sorted(r["line"] for r in bad.collect()) == ["long\tx\t1\t2", "short\tx"]
    assert good.select("tag").count() == 3  # also where few columns are asked for


def test_quoted_line_breaks(spark, tmp_path):
    text = tmp_path / "sub.txt"
    text.write_text('adsh\tname\tfp\na\t"two\nlines"\tQ1\nb\tone\tQ2\n')
    good, bad = readers.read_tab_rows(spark, str(text), multiline=True)
    assert sorted(map(tuple, good.collect())) == [("a", "two\nlines", "Q1"), ("b", "one", "Q2")] and bad.count() == 0
    # Line by line the halves are not rows of the table, and are kept as they are.
    good, bad = readers.read_tab_rows(spark, str(text))
    assert [tuple(r) for r in good.collect()] == [("b", "one", "Q2")] and bad.count() == 2


def test_landing_keeps_what_it_cannot_read(spark, tmp_path):
    header, fact = tmp_path / "sub.txt", tmp_path / "num.txt"
    header.write_text("adsh\tcik\nx\t1\nbroken\n")
    fact.write_text("adsh\ttag\nx\tRevenues\n")
    for _ in range(2):  # landing a quarter again replaces it, rejected rows included
        landing.land_filings(spark, str(header), str(fact), "2024q1", str(tmp_path / "raw"))
    rejected = landing.rejected_text(spark, str(tmp_path / "raw"))
    assert [tuple(r) for r in rejected.collect()] == [("filings", "2024q1", "broken")]
    assert readers.read_quarters(spark, str(tmp_path / "raw/filings")).count() == 1
    assert readers.read_quarters(spark, str(tmp_path / "raw/facts")).first()["segments"] is None
    header.write_text("adsh\tcik\nx\t1\n")
    landing.land_filings(spark, str(header), str(fact), "2024q1", str(tmp_path / "raw"))
    assert landing.rejected_text(spark, str(tmp_path / "raw")).count() == 0
