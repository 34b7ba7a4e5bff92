"""From a panel to final exposures: checks, as-of filter, formulas, transforms, validation, metadata, artifacts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.expressions import KEYS
from ..operators.factors import Factor, check_factors, compute_raw_exposures
from ..operators.transforms import factor_columns, neutralize, orthogonalize, winsorize, zscore
from ..sources.files import exists, joined, write_json, write_whole
from ..sources.scratch import stored


@dataclass(frozen=True)
class PipelineConfig:
    as_of: str | dt.date
    lower_quantile: float = 0.025
    upper_quantile: float = 0.975
    ddof: int = 0
    neutralize: bool = False
    neutralize_industry: bool = True
    neutralize_size: bool = True
    industry_column: str = "gics_sector"
    market_cap_column: str = "market_cap"
    orthogonalize: bool = False
    correlation_threshold: float = 0.70
    output_dir: str | None = None
    exposures_name: str = "exposures.parquet"
    metadata_name: str = "metadata.json"
    compression: str = "snappy"
    overwrite: bool = False

    def __post_init__(self):
        parse_as_of(self.as_of)
        for name in ("neutralize", "neutralize_industry", "neutralize_size", "orthogonalize", "overwrite"):
            if not isinstance(getattr(self, name), bool):
                raise TypeError(f"{name} must be a bool")
        for name in ("lower_quantile", "upper_quantile", "correlation_threshold"):
            if isinstance(getattr(self, name), bool) or not isinstance(getattr(self, name), (int, float)):
                raise TypeError(f"{name} must be a number")
        if not 0 <= self.lower_quantile < self.upper_quantile <= 1:
            raise ValueError("quantiles must satisfy 0 <= lower < upper <= 1")
        if not 0 <= self.correlation_threshold <= 1:
            raise ValueError("correlation_threshold must be between 0 and 1")
        if isinstance(self.ddof, bool) or not isinstance(self.ddof, int):
            raise TypeError("ddof must be an integer")
        if self.ddof < 0:
            raise ValueError("ddof must not be negative")
        for name in ("exposures_name", "metadata_name"):
            if not getattr(self, name) or Path(getattr(self, name)).name != getattr(self, name):
                raise ValueError(f"{name} must be a bare file name")


@dataclass(frozen=True)
class PipelineResult:
    exposures: DataFrame
    metadata: dict
    paths: tuple[str, str] | None = None


def parse_as_of(as_of) -> dt.date:
    """Text or a date (time of day dropped); no time zones."""
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo is not None:
            raise ValueError("as_of must not have a time zone")
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    if not isinstance(as_of, str):
        raise TypeError("as_of must be text or a date")
    parsed = dt.datetime.fromisoformat(as_of)
    if parsed.tzinfo is not None:
        raise ValueError("as_of must not have a time zone")
    return parsed.date()


def filter_as_of(panel: DataFrame, as_of) -> DataFrame:
    """Rows up to as_of; the filter stands below all windows, so it reaches the scan. ValueError if nothing is left."""
    held = panel.where(F.col("Date") <= F.lit(parse_as_of(as_of)))
    if held.isEmpty():
        raise ValueError("no panel rows at or before as_of")
    return held


def apply_transforms(raw: DataFrame, panel: DataFrame, config: PipelineConfig) -> DataFrame:
    x = zscore(winsorize(raw, lower_quantile=config.lower_quantile, upper_quantile=config.upper_quantile), ddof=config.ddof)
    if config.neutralize:
        x = neutralize(x, panel, industry_column=config.industry_column, market_cap_column=config.market_cap_column, neutralize_industry=config.neutralize_industry, neutralize_size=config.neutralize_size)
    return orthogonalize(x, correlation_threshold=config.correlation_threshold) if config.orthogonalize else x


def get_exposures(panel: DataFrame, factors: Sequence[Factor], *, as_of) -> DataFrame:
    """Raw factors up to as_of, winsorized at 1 and 99 percent, standardized, sorted by key."""
    check_factors(factors, panel.columns)
    raw = stored(compute_raw_exposures(filter_as_of(panel, as_of), factors), "raw")
    return zscore(winsorize(raw)).orderBy(*KEYS)


def exposure_statistics(x: DataFrame) -> DataFrame:
    """factor, missing, finite, infinite, missing_rate: one aggregate over all factors."""
    names = factor_columns(x)
    counts = x.agg(F.count("*").alias("n"), *[s for i, c in enumerate(names) for s in (F.count(c).alias(f"c{i}"), F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"i{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("factor"), (F.col("n") - F.col(f"c{i}")).alias("missing"), (F.col(f"c{i}") - F.col(f"i{i}")).alias("finite"), F.col(f"i{i}").alias("infinite"), F.try_divide((F.col("n") - F.col(f"c{i}")).cast("double"), F.col("n")).alias("missing_rate")) for i, c in enumerate(names)])
    return counts.select(F.inline(rows))


def validate_final_exposures(x: DataFrame, panel: DataFrame, factors: Sequence[str], as_of) -> None:
    """ValueError unless x has the factors in order, the panel's keys each once, no later date and no infinite value."""
    if x.columns != [*KEYS, *factors]:
        raise ValueError("exposure columns must be the keys and the factors, in order")
    if any(not isinstance(x.schema[c].dataType, T.NumericType) for c in factors):
        raise ValueError("exposures must be numeric")
    infinite = sum((F.count_if(F.abs(F.col(c)) == float("inf")) for c in factors), F.lit(0))
    facts = x.agg(F.max("Date").alias("last"), infinite.alias("infinite")).first()
    if facts["last"] is not None and facts["last"] > parse_as_of(as_of):
        raise ValueError("exposures hold dates after as_of")
    if facts["infinite"]:
        raise ValueError("exposures hold infinite values")
    sides = x.select(*KEYS, F.lit(1).alias("x"), F.lit(0).alias("p")).unionByName(panel.select(*KEYS, F.lit(0).alias("x"), F.lit(1).alias("p")))
    if not sides.groupBy(*KEYS).agg(F.sum("x").alias("x"), F.sum("p").alias("p")).where("x <> 1 or p <> 1").isEmpty():
        raise ValueError("exposure keys must be those of the panel, each once")


def build_metadata(x: DataFrame, factors: Sequence[Factor], config: PipelineConfig) -> dict:
    facts = x.agg(F.count("*").alias("rows"), F.count_distinct("Ticker").alias("tickers"), F.count_distinct("Date").alias("dates"), F.min("Date").alias("first"), F.max("Date").alias("last")).first()
    per = {r["factor"]: {"missing": r["missing"], "finite": r["finite"], "missing_rate": r["missing_rate"]} for r in exposure_statistics(x).collect()}
    settings = asdict(config) | {"as_of": parse_as_of(config.as_of).isoformat()}
    return {"rows": facts["rows"], "tickers": facts["tickers"], "dates": facts["dates"], "first_date": facts["first"] and facts["first"].isoformat(), "last_date": facts["last"] and facts["last"].isoformat(), "factors": [{"name": f.name, "required_columns": list(f.required_columns)} | per[f.name] for f in factors], "config": settings}


def write_artifacts(x: DataFrame, metadata: dict, config: PipelineConfig) -> tuple[str, str]:
    spark, out = x.sparkSession, config.output_dir or "."
    targets = joined(out, config.exposures_name), joined(out, config.metadata_name)
    if not config.overwrite and (there := [t for t in targets if exists(spark, t)]):
        raise FileExistsError(f"targets exist: {there}")
    write_whole(x, targets[0], overwrite=config.overwrite, compression=config.compression)
    write_json(spark, targets[1], metadata, overwrite=config.overwrite)
    return targets


def run_pipeline(panel: DataFrame, factors: Sequence[Factor], config: PipelineConfig) -> PipelineResult:
    needed = [config.industry_column] * config.neutralize_industry + [config.market_cap_column] * config.neutralize_size if config.neutralize else []
    check_factors(factors, panel.columns)
    if missing := [c for c in needed if c not in panel.columns]:
        raise ValueError(f"panel is missing neutralization columns: {missing}")
    held = filter_as_of(panel, config.as_of)
    x = stored(apply_transforms(stored(compute_raw_exposures(held, factors), "raw"), held, config), "exposures")
    validate_final_exposures(x, held, [f.name for f in factors], config.as_of)
    metadata = build_metadata(x, factors, config)
    ordered = x.orderBy(*KEYS)
    return PipelineResult(ordered, metadata, write_artifacts(ordered, metadata, config) if config.output_dir else None)


def write_validation_report(result: dict[str, DataFrame], output_dir, *, overwrite: bool = False, compression: str = "snappy") -> list[str]:
    """A Parquet table for each part of validate_factors, and the summary as strict JSON."""
    spark = result["summary"].sparkSession
    targets = {k: joined(output_dir, f"{k}.parquet") for k in result}
    summary = joined(output_dir, "summary.json")
    if not overwrite and (there := [t for t in (*targets.values(), summary) if exists(spark, t)]):
        raise FileExistsError(f"targets exist: {there}")
    for k, t in targets.items():
        write_whole(result[k], t, overwrite=overwrite, compression=compression)
    write_json(spark, summary, {r["factor"]: r.asDict() for r in result["summary"].collect()}, overwrite=overwrite)
    return [*targets.values(), summary]
