"""Dividend files by the names in their headers."""

from candlewright.sources import candles

# 41 published payments, by name.
PAID = {
    "SBER": ("RU0009029540", "2019-06-13 16.0, 2020-10-05 18.7, 2021-05-12 18.7, 2023-05-11 25.0, 2024-07-11 33.3, 2025-07-18 34.84"),
    "SBERP": ("RU0009029557", "2019-06-13 16.0, 2020-10-05 18.7, 2021-05-12 18.7, 2023-05-11 25.0, 2024-07-11 33.3, 2025-07-18 34.84"),
    "T": ("RU000A107UL4", "2024-11-25 92.5, 2025-05-16 32.0, 2025-07-17 33.0"),
    "MBNK": ("RU000A0JRH43", "2018-07-13 0.25, 2019-07-12 1.8, 2025-07-11 89.31"),
    "VTBR": ("RU000A0JP5V6", "2014-07-01 0.0, 2015-07-06 0.0, 2016-07-04 0.0, 2016-12-26 0.01, 2017-05-10 0.0, 2018-06-04 0.0, 2019-06-24 0.00109867761463259, "
        "2020-10-05 0.00077345337561138, 2021-06-22 1.73965919370917e-05, 2021-07-15 1.73965919370917e-05, 2025-07-11 25.58"),
    "CBOM": ("RU000A0JUG31", "2019-06-07 0.11"),
    "SVCB": ("RU000A0ZZAC4", "2018-11-08 0.0801497515821, 2019-01-21 0.1602995031642, 2019-05-11 0.0507767680824497, 2019-07-01 0.088859344144287, 2019-09-26 0.116786566589634, "
        "2020-01-04 0.111708889781389, 2021-02-14 0.2792722244534733, 2021-07-11 0.0660097985071846, 2023-11-13 0.262531330926804, 2024-07-08 1.14, 2025-07-08 0.35"),
}


def lines(date, name):
    """The payments as a file whose header has these names."""
    rows = [f"{d};{n};{isin};{v};RUB" for n, (isin, paid) in PAID.items() for d, v in (p.split() for p in paid.split(", "))]
    return "\n".join([f"{date};{name};isin;value;currencyid", *rows]) + "\n"


def test_all_payments_are_read(spark, tmp_path):
    (tmp_path / "own.csv").write_text(lines("date", "name"))
    got = candles.read_dividends(spark, f"{tmp_path}/own.csv").collect()
    assert len(got) == 41 and all(r.date and r.isin and r.value is not None and r.currencyid == "RUB" for r in got)
    counts = {n: sum(r.name == n for r in got) for n in PAID}
    assert counts == {"SBER": 6, "SBERP": 6, "T": 3, "MBNK": 3, "VTBR": 11, "CBOM": 1, "SVCB": 11}
    assert {(r.name, str(r.date), r.value) for r in got} == {(n, p.split()[0], float(p.split()[1])) for n, (_, paid) in PAID.items() for p in paid.split(", ")}


def test_names_of_the_exchange_in_any_order_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(lines("registryclosedate", "secid"))
    (tmp_path / "b.csv").write_text("secid;value;registryclosedate\nX;oops;2024-02-30\nY;1e-3;2024-02-29\n")
    got = candles.read_dividends(spark, f"{tmp_path}/a.csv", f"{tmp_path}/b.csv")
    assert got.count() == 43 and got.columns == ["date", "name", "isin", "value", "currencyid"]
    assert [tuple(map(str, r)) for r in got.filter("name IN ('X', 'Y')").orderBy("name").collect()] == [("None", "X", "None", "None", "None"), ("2024-02-29", "Y", "None", "0.001", "None")]


def test_the_isin_that_a_service_answers_with(spark):
    df = spark.createDataFrame([("SBER", "x")], "ticker string, isin string")
    assert [candles.original_isin(df, i).first().isin for i in ("RU1", "", None)] == ["RU1", "", ""]
