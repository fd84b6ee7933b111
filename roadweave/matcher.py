"""One object with both networks and the parameters that all modes share."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from roadweave.log import get_logger
from roadweave.operators import dag, pairs, points, quality, resolve, routes, thresholds
from roadweave.sources import edges
from roadweave.sources.geopackage import read_geopackage

log = get_logger("matcher")


@dataclass(frozen=True)
class Matcher:
    """Source and target as (id, pts) in metres; `set_parameters` gives a changed copy. min_overlap is a percentage."""

    a: DataFrame
    b: DataFrame
    max_distance: float = 25.0
    max_angle: float = 180.0
    min_overlap: float = 0.0

    @classmethod
    def from_frames(cls, a: DataFrame, b: DataFrame, *, id_a: str = "id", id_b: str = "id", geom_a: str = "geometry", geom_b: str = "geometry", utm_srid: int | None = None, id_cast: str | None = None, keep_cols_a: tuple[str, ...] = (), keep_cols_b: tuple[str, ...] = (), always_xy: bool = True, kind_a: str = "LINESTRING", **parameters) -> Matcher:
        """Any relations with an id and WKT or vertices; tables by name are spark.table(name)."""
        more = {"srid": utm_srid, "id_cast": id_cast, "always_xy": always_xy}
        return cls(edges.bind(a, id_a, geom_a, keep=keep_cols_a, kind=kind_a, **more), edges.bind(b, id_b, geom_b, keep=keep_cols_b, **more), **parameters)

    @classmethod
    def from_wkt_csv(cls, spark: SparkSession, csv_a: str, csv_b: str, *, id_a: str = "edge_id", id_b: str = "edge_id", utm_srid: int | None = None, geom_col: str = "geometry", id_cast: str | None = "bigint", keep_cols_a: tuple[str, ...] = (), keep_cols_b: tuple[str, ...] = (), always_xy: bool = True, **parameters) -> Matcher:
        more = {"geom_col": geom_col, "srid": utm_srid, "id_cast": id_cast, "always_xy": always_xy}
        return cls(edges.read_wkt_csv(spark, csv_a, id_a, keep=keep_cols_a, **more), edges.read_wkt_csv(spark, csv_b, id_b, keep=keep_cols_b, **more), **parameters)

    @classmethod
    def from_geojson(cls, spark: SparkSession, path_a: str, path_b: str, *, id_a: str = "edge_id", id_b: str = "edge_id", utm_srid: int | None = None, id_cast: str | None = "bigint", **parameters) -> Matcher:
        return cls(*(edges.read_geojson(spark, p, i, srid=utm_srid, id_cast=id_cast) for p, i in ((path_a, id_a), (path_b, id_b))), **parameters)

    @classmethod
    def from_geopackage(cls, spark: SparkSession, path_a: str, path_b: str, *, id_a: str = "edge_id", id_b: str = "edge_id", layer_a: str | None = None, layer_b: str | None = None, utm_srid: int | None = None, id_cast: str | None = "bigint", **parameters) -> Matcher:
        return cls(*(read_geopackage(spark, p, i, layer=n, srid=utm_srid, id_cast=id_cast) for p, i, n in ((path_a, id_a, layer_a), (path_b, id_b, layer_b))), **parameters)

    def set_parameters(self, **parameters) -> Matcher:
        log.info("parameters: %s", parameters)
        return replace(self, **parameters)

    def match(self) -> DataFrame:
        return pairs.match(self.a, self.b, self.max_distance, self.max_angle, self.min_overlap)

    def match_symmetric(self, **more) -> DataFrame:
        return pairs.match_symmetric(self.a, self.b, self.max_distance, **more)

    def match_points(self) -> DataFrame:
        return points.match_points(self.a, self.b, self.max_distance)

    def match_routes(self, **more) -> tuple[DataFrame, DataFrame]:
        return routes.match_routes(self.a, self.b, max_distance=self.max_distance, **more)

    def match_dag(self, **more) -> dict[str, DataFrame]:
        return dag.match_dag(self.a, self.b, self.max_distance, **more)

    def resolve(self, results: DataFrame, strategy: str = "best_per_source") -> DataFrame:
        return resolve.resolve(results, strategy)

    def resolve_routes(self, summary: DataFrame, long: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame | None]:
        return routes.resolve_routes(summary, long, **limits)

    def suggest_thresholds(self, summary: DataFrame, **more) -> dict:
        return thresholds.suggest_thresholds(summary, **more)

    def validate_b_geometry(self, **more) -> tuple[DataFrame, DataFrame]:
        return quality.check_network(self.b, **more)
