"""Lineage cuts keep no estimates."""

import re

from lexistat.functions.session import cut_lineage


def test_estimates_do_not_multiply_by_rounds(spark, capsys):
    df = spark.range(50)
    for _ in range(5):
        df = cut_lineage(df.join(df.select("id"), "id"))
    df.explain("cost")
    size = re.search(r"sizeInBytes=([\d.E+]+) (\w+)", capsys.readouterr().out)
    assert df.count() == 50 and size and size.group(2) in ("B", "KiB")
