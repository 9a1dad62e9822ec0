"""Bars to validated, normalised bars in one plan over all symbols."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators.quality import NORMALIZERS, clean_bars, quality_report, validate_bars
from barweave.operators.returns import simple_returns
from barweave.session import settle


class Processed(NamedTuple):
    data: DataFrame  # bars of the symbols that passed
    outcome: DataFrame  # symbol, success and the validation report
    quality: DataFrame  # nested quality report of the symbols that passed


def process_bars(bars: DataFrame, normalize: str | None = None, first_by: str | None = None, universe: DataFrame | None = None) -> Processed:
    # written once: the report, the routing and the normalisation all read it
    cleaned = settle(simple_returns(clean_bars(bars, first_by=first_by), drop_first=False))
    outcome = validate_bars(cleaned, universe=universe).withColumn("success", F.col("is_valid"))
    passed = cleaned.join(outcome.filter("success").select("symbol"), "symbol", "left_semi")
    data = NORMALIZERS[normalize](passed) if normalize else passed
    return Processed(data, outcome, quality_report(passed))
