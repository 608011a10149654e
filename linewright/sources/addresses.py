"""Dataset addresses ``org/dataset[/config][/split]`` and the choice of split files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an address means when parts are left out.
SCHEME = "hf://"
DEFAULT_CONFIG = "default"
DEFAULT_SPLIT = "train"


def resolve_split_address(address: Column) -> Column:
    """``struct<org,dataset,config,split>``; NULL where the address is not valid.

    A third part is the split; with four parts the third is the configuration and the
    fourth keeps any further slashes.
    """
    parts = F.split(F.substr(address, F.lit(len(SCHEME) + 1)), "/", 4)
    size = F.size(parts)
    target = F.struct(
        F.get(parts, F.lit(0)).alias("org"),
        F.get(parts, F.lit(1)).alias("dataset"),
        F.when(size == 4, F.get(parts, F.lit(2))).otherwise(DEFAULT_CONFIG).alias("config"),
        F.when(size == 4, F.get(parts, F.lit(3)))
        .when(size == 3, F.get(parts, F.lit(2)))
        .otherwise(DEFAULT_SPLIT)
        .alias("split"),
    )
    return F.when(address.startswith(SCHEME) & (size >= 2), target)


def display_name(target: Column) -> Column:
    """``org/dataset [config:split]``."""
    return F.format_string(
        "%s/%s [%s:%s]", target["org"], target["dataset"], target["config"], target["split"]
    )


def select_split_files(
    listing: DataFrame, config: str, split: str, order: str = "path", first_file: bool = False
) -> DataFrame:
    """Listed files (``config``, ``split``, ``path``, ...) of one split.

    Every shard of the split is returned, and none if there is no such split.  Wanting
    ``default`` accepts any configuration.  With ``first_file``, a split that is not there
    is answered with the first file of the listing.
    """
    wanted = F.col("split") == split
    if config != DEFAULT_CONFIG:
        wanted = wanted & (F.col("config") == config)
    matching = listing.filter(wanted)
    if not first_file:
        return matching
    found = matching.limit(1).agg(F.count(F.lit(1))).scalar()
    fallback = listing.orderBy(order).limit(1).filter(found == 0)
    return matching.unionByName(fallback)
