"""The engine's functions under their names in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.jsontext import prov_canonical, prov_minified_len
from ..operators.shred import prov_shred
from ..operators.views import prov_pack, prov_unpack

FUNCTIONS = {"prov_canonical": prov_canonical, "prov_minified_len": prov_minified_len, "prov_pack": prov_pack, "prov_unpack": prov_unpack}


def register(spark: SparkSession) -> None:
    """Scalar functions prov_canonical, prov_minified_len, prov_pack, prov_unpack and the table function prov_shred."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("prov_shred", prov_shred)
