"""Format strings of record headers, options of CSV files, and the order of arguments of exports."""

import csv
import glob

import pytest

import seqloom as sl
from seqloom.functions.formats import filled_in
from seqloom.sources.sinks import fasta_lines

NUMBERS = [0, 7, -7, 1234567, -98765]
FLOATS = [0.0, 0.5, -2.3, 1234567.875, 1e-3]
TEXTS = ["", "a", "abc", "longer than ten"]


@pytest.mark.parametrize(
    ("values", "specs"),
    [
        (NUMBERS, ["d", "5d", "05d", "+d", " d", "<6", ">6", "^7", "*^9d", "x=8d", ",", ",d", "+,d", "012,d".replace(",", ""), "x", "X", "b", "o", "08x", ".2f", "9.1f", "e", ".1%"]),
        (FLOATS, [".2f", "f", "8.3f", "08.2f", "+.1f", "<12.2f", "^12.2f", ".3e", ".2E", ",.2f", ".1%", "_>9.1f"]),
        (TEXTS, ["s", "10", "<10", ">10", "^10", "*>6s", ".2", "6.2s", "-^8"]),
    ],
)
def test_format_specifications(spark, values, specs):
    df = spark.createDataFrame([(v,) for v in values], ["v"])
    template = "".join(f"[{{v:{s}}}]" for s in specs)
    got = [r[0] for r in df.select(filled_in(template, df)).collect()]
    assert got == [template.format(v=v) for v in values]


def test_halves_are_rounded_away_from_zero(spark):
    df = spark.createDataFrame([(-2.25,), (2.25,)], ["v"])
    assert [r[0] for r in df.select(filled_in("{v:.1f}", df)).collect()] == ["-2.3", "2.3"]


def test_specifications_of_other_types(spark):
    df = spark.createDataFrame([("a", 1, 1.5)], ["s", "n", "x"])
    for bad in ("{s:d}", "{s:.2f}", "{n:s}", "{n:.2d}", "{x:d}", "{s:,}", "{n:q}"):
        with pytest.raises(ValueError):
            filled_in(bad, df)
    with pytest.raises(KeyError):
        filled_in("{other}", df)


def test_missing_values_and_plain_templates(spark):
    df = spark.createDataFrame([("A", None, "p")], "seq string, n long, name string")
    assert [r["value"] for r in fasta_lines(df, "n={n:>3};{n:05d};{n}").collect()] == [">p n=   ;00000;\nA"]
    assert [r["value"] for r in fasta_lines(df, "no {{field}}").collect()] == [">p no {field}\nA"]
    assert [r["value"] for r in fasta_lines(df, "").collect()] == [">p \nA"]


def written(path):
    return sorted({line for f in glob.glob(f"{path}/part-*") for line in open(f, newline="").read().split("\n") if line})


def test_options_of_csv_files(spark, session, tmp_path):
    pool = sl.from_seqs(["A", "C,G"], mode="sequential")
    run = lambda name, **options: (pool.to_file(tmp_path / name, "csv", num_cycles=1, spark=spark, **options), written(tmp_path / name))[1]
    assert run("plain")[-1] == "name,seq" and any(line.endswith('"C,G"') for line in run("same"))
    assert run("sep", sep=";", na_rep="NA", index=False) == ["NA;A", "NA;C,G", "name;seq"]
    assert run("all", quoting=csv.QUOTE_ALL, na_rep="-", quotechar="'", header=False) == ["'-','A'", "'-','C,G'"]
    assert run("options", csv_options={"sep": "|", "header": False}, nullValue="0") == ["0|A", "0|C,G"]
    for bad in ({"quoting": 2}, {"index": True}):
        with pytest.raises(ValueError):
            run("bad", **bad)
    with pytest.raises(TypeError):
        pool.to_file(tmp_path / "f", "fasta", num_cycles=1, sep=";")


def test_order_of_arguments(spark, session, tmp_path):
    pool = sl.from_seq("A<r>C</r>").mutagenize("r", num_mutations=1, mode="sequential", prefix="m")
    assert sorted(r["seq"] for r in pool.to_df(None, 1, 100, True).collect()) == ["A<r>A</r>", "A<r>G</r>", "A<r>T</r>"]
    assert pool.to_df(None, 1, 100, False, False, 3, True, True, ["seq"]).columns == ["seq"]
    assert sorted(r["seq"] for r in pool.to_df(num_cycles=1, remove_tags=False).collect())[0] == "A<r>A</r>"
    assert pool.to_file(tmp_path / "x", "fasta", 2, None, 10, False, False, 1, True, False, None, 1, "of {name:>5}") == 2
    assert written(tmp_path / "x") == [">m_0 of   m_0", ">m_1 of   m_1", "A", "G"]
