"""A catalogue stored for repeated nearest-neighbour searches.

:func:`write` lays a catalogue out once: folded to one object a position, copied into every search cell its
reach touches (halo copies), written in buckets of cells and sorted by cell within each. A search then
exchanges the left objects only; the stored side is read bucket by bucket where it lies. Cells with more
than ``crowd`` objects are listed beside it, so a search has no look for them to do.

A folder holds ``cells`` (the buckets), ``full`` (crowded cells) and ``about`` (one row: how it was built).
:func:`reopen` finds it again from any session by its path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylattice.functions import sky
from skylattice.operators import crossmatch, crowded
from skylattice.operators.crossmatch import CELLS, RIGHT, SEARCH_SIDE

ABOUT = "radius double, buckets int, crowd int, crowded boolean, key string, payload array<string>, layout string"


@dataclass(frozen=True)
class SkyIndex:
    """A stored catalogue: which columns it offers and up to which radius it can be searched."""

    cells: DataFrame
    full: DataFrame
    has_crowds: bool
    key: str
    payload: tuple[str, ...]
    radius_arcsec: float
    crowd: int

    def nearest(
        self, left: DataFrame, radius_arcsec: float, left_key: Sequence[str], payload: Sequence[str] | None = None,
        left_coords: tuple[str, str] = ("RA", "DEC"), carry: Sequence[str] = (),
    ) -> DataFrame:
        """As :func:`skylattice.operators.crossmatch.nearest`, with this catalogue as the right side.

        Only the ``payload`` named is read (all of it if None). The radius may be smaller than that of the
        index, not larger: halo copies reach no farther.
        """
        if radius_arcsec > self.radius_arcsec:
            raise ValueError(f"the index reaches {self.radius_arcsec} arcsec, not {radius_arcsec}")
        payload = list(self.payload if payload is None else payload)
        if lacking := [p for p in payload if p not in self.payload]:
            raise ValueError(f"the index holds no {lacking}")
        reached = self.cells.select(
            *CELLS, "_rra", "_rdec", *RIGHT,
            F.struct(*[F.col(f"_right.{c}").alias(c) for c in ("_key", *payload)]).alias("_right"))
        found = crossmatch.search_cells(
            crossmatch.seekers(left, left_key, left_coords, carry), reached,
            self.full if self.has_crowds else None, left_key, radius_arcsec,
            side=sky.reach(self.radius_arcsec) * SEARCH_SIDE, crowd=self.crowd, stored=True,
        )
        return crossmatch.found_columns(found, left_key, self.key, payload, carry)


def write(
    df: DataFrame, path: str, key: str, radius_arcsec: float, payload: Sequence[str] = (),
    coords: tuple[str, str] = ("RA", "DEC"), buckets: int | None = None, crowd: int | None = None,
) -> SkyIndex:
    """Store ``df`` below ``path`` for searches up to ``radius_arcsec`` and open it.

    Rows without a position are left out; of several at one position the one with the smallest key stands
    for all, as in :func:`skylattice.operators.crossmatch.nearest`. ``buckets`` (the session's shuffle
    partitions by default) should make a bucket a few hundred megabytes; one cell lies in one bucket.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    crowd = crowded.CROWD if crowd is None else crowd
    radius = sky.reach(radius_arcsec)
    offered = crossmatch.offers(df, key, payload, coords)
    placed = sky.with_reached_cells(offered, RIGHT, CELLS, radius * SEARCH_SIDE, radius)
    name = _name()
    # one file a bucket: the task that holds a bucket's rows writes them
    (placed.repartition(buckets, *CELLS).write.bucketBy(buckets, *CELLS).sortBy(*CELLS)
     .option("path", f"{path}/cells").format("parquet").saveAsTable(name))
    crowded.crowded_cells(spark.table(name), CELLS, crowd).write.parquet(f"{path}/full")
    has_crowds = not spark.read.parquet(f"{path}/full").isEmpty()
    spark.sql(f"DROP TABLE {name}")  # the files stay
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    row = (float(radius_arcsec), buckets, crowd, has_crowds, key, list(payload), layout)
    spark.createDataFrame([row], ABOUT).coalesce(1).write.parquet(f"{path}/about")
    return reopen(spark, path)


def reopen(spark: SparkSession, path: str) -> SkyIndex:
    """A stored catalogue, in this or another session than the one that wrote it."""
    about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
    return SkyIndex(
        _cells(spark, path, about.layout, about.buckets), spark.read.parquet(f"{path}/full"), about.crowded,
        about.key, tuple(about.payload), about.radius, about.crowd,
    )


def _name() -> str:
    return f"sky_index_{uuid.uuid4().hex}"


def _cells(spark: SparkSession, path: str, layout: str, buckets: int) -> DataFrame:
    """The buckets as a table of the session's catalogue: only a table tells Spark of its buckets."""
    name, by = _name(), ", ".join(f"`{c}`" for c in CELLS)
    spark.sql(f"CREATE TABLE {name} ({layout}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS"
              f" LOCATION '{path}/cells'")
    return spark.table(name)
