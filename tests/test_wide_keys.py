"""Order numbers of over 20 bits, as larger tables have them, against the queries' SQL."""

import duckdb
import pytest

from tests.test_catalog import normal
from tracetide.functions import values
from tracetide.plans import catalog

KEYS = [0, 1, 7, 8, 9, 150_000, 2**20 - 1, 2**20, 2**20 + 1, 2**20 + 3, 8_999_999, 2**23 + 5, 54_000_001, 2**26 - 1]


@pytest.mark.parametrize("name", ["q32_to_bits", "q33_slice_bits", "q34_concat_bits", "q39_numbers", "q40_get_bit", "q65_wide_numbers"])
def test_keys_of_over_20_bits(spark, tmp_path, name):
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey bigint").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = con.execute(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(c[0] for c in want.description)
    assert normal(map(tuple, df.collect()), df.columns) == normal(want.fetchall(), [c[0] for c in want.description])


def test_numbers_beside_themselves(spark):
    found = spark.createDataFrame([(k,) for k in (0, 1, 2**62 - 1, None)], "k bigint").select("k", values.side_by_side(values.F.col("k"), 20, 6).alias("bits")).collect()
    assert all(r.bits is None if r.k is None else int(r.bits, 2) == r.k * catalog.WIDE_FACTOR for r in found)
    for wrong in (-1, 2**62):
        with pytest.raises(Exception, match="negative or has over"):
            spark.range(1).select(values.side_by_side(values.F.lit(wrong), 20, 6)).collect()
