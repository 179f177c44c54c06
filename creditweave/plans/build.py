"""Feature build: staging check, feature tables, profile, contracts and inventories."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from creditweave.operators import contracts
from creditweave.plans.mart import FeatureTables
from creditweave.schemas import staging_name
from creditweave.settings import Settings
from creditweave.sources.reports import write_csv, write_table
from creditweave.sources.staging import required_sources, timestamp_text
from creditweave.sources.workspace import store


class BuildError(RuntimeError):
    """The feature build cannot start."""


@dataclass(frozen=True)
class Build:
    tables: dict[str, DataFrame]
    profile: DataFrame
    data_inventory: DataFrame
    feature_inventory: DataFrame

    @property
    def mart(self) -> DataFrame:
        return self.tables[contracts.MART]


def build_features(
    staging: Mapping[str, DataFrame],
    folder: str,
    report_folder: str | None = None,
    settings: Settings = Settings(),
) -> Build:
    """Write every feature table of the scope, then profile and check what was written.

    The histories are collapsed once; all tables and the mart are made from those copies.

    The mart is partitioned by population, so training and scoring read only their part.
    """
    needed = {staging_name(s) for s in required_sources(settings)}
    missing = sorted(needed - set(staging))
    if missing:
        raise BuildError(f"Missing staging tables: {', '.join(missing)}")
    created_at = timestamp_text()
    tables: dict[str, DataFrame] = {k: staging[k] for k in sorted(needed)}
    digests = FeatureTables(staging).keep(lambda n, d: store(d, n).frame, settings.post_v1)
    for name, plan in digests.named(settings.post_v1).items():
        path = f"{folder.rstrip('/')}/{name}"
        write_table(plan, path, ("source_population",) if name == contracts.MART else ())
        written = plan.sparkSession.read.schema(plan.schema).parquet(path)
        tables[name] = written.select(*plan.columns)
    features = {k: v for k, v in tables.items() if not k.startswith("stg_")}
    profile = contracts.mart_profile(features, created_at)
    if report_folder:
        write_csv(profile, "feature_mart_profile", f"{report_folder}/feature_mart_profile")
    contracts.require_contracts(tables, settings)
    inventory = contracts.data_inventory(tables, created_at, settings)
    columns = contracts.feature_inventories(tables, created_at, settings)
    if report_folder:
        write_csv(inventory, "data_inventory", f"{report_folder}/data_inventory")
        write_csv(columns, "feature_inventory", f"{report_folder}/feature_inventory")
    return Build(tables, profile, inventory, columns)
