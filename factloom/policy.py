"""Evidence policy: which sources and fields exist, how conflicts are settled, how changes are graded."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PATH = Path(__file__).parent / "data" / "evidence_policy.json"
REQUIRED = {
    "fact_statuses": {"current", "superseded", "conflicted"},
    "verification_statuses": {"needs_review", "reviewed_supported", "reviewed_unsupported", "reviewed_conflicted",
                              "superseded"},
    "answer_routes": {"structured_fact", "comparison", "change_query", "trial_lookup", "literature_evidence", "refusal"},
}
RESOLUTIONS = {"flag_conflict", "preserve_all", "authoritative_first"}


def _literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


@dataclass(frozen=True)
class Policy:
    version: str
    sources: dict[str, dict]
    fields: dict[str, dict]
    change_types: dict[str, dict]
    verification_statuses: tuple[str, ...]

    # The policy has a few dozen entries, so it travels inside the plan as literal maps and needs no join.

    def resolution(self, predicate: Column) -> Column:
        return F.try_element_at(_literal_map({p: f["conflict_resolution"] for p, f in self.fields.items()}), predicate)

    def value_type(self, predicate: Column) -> Column:
        return F.try_element_at(_literal_map({p: f["value_type"] for p, f in self.fields.items()}), predicate)

    def source_rank(self, predicate: Column, source: Column) -> Column:
        """Position of the source among the preferred sources of the field; unknown sources come last."""
        ranks = {f"{p}\u001f{s}": i for p, f in self.fields.items() for i, s in enumerate(f["preferred_sources"])}
        last = _literal_map({p: len(f["preferred_sources"]) + 1 for p, f in self.fields.items()})
        return F.coalesce(F.try_element_at(_literal_map(ranks), F.concat_ws("\u001f", predicate, source)),
                          F.try_element_at(last, predicate))

    def max_age_hours(self, source: Column) -> Column:
        ages = {s: v["max_age_hours"] for s, v in self.sources.items() if v["max_age_hours"] is not None}
        return F.try_element_at(_literal_map(ages), source)

    def display_name(self, source: Column) -> Column:
        return F.coalesce(F.try_element_at(_literal_map({s: v["display_name"] for s, v in self.sources.items()}), source),
                          source)

    def change_type(self, predicate: Column) -> Column:
        """``<predicate>.changed`` if listed, the structure event for other ``adc.`` fields, else the general event."""
        exact = F.concat(predicate, F.lit(".changed"))
        result = F.when(exact.isin(*self.change_types), exact)
        if "adc.structure.changed" in self.change_types:
            result = result.when(predicate.startswith("adc."), "adc.structure.changed")
        return result.otherwise("fact.value_changed")

    def severity(self, event_type: Column) -> Column:
        return F.try_element_at(_literal_map({e: v["severity"] for e, v in self.change_types.items()}), event_type)

    def attention(self, event_type: Column) -> Column:
        return F.try_element_at(_literal_map({e: v["attention_required"] for e, v in self.change_types.items()}), event_type)

    def fields_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, f["value_type"], f["cardinality"], f["conflict_resolution"], f["preferred_sources"])
                for p, f in self.fields.items()]
        return spark.createDataFrame(rows, "predicate string, value_type string, cardinality string, "
                                           "conflict_resolution string, preferred_sources array<string>")


def parse_policy(payload: dict) -> Policy:
    """Check the references inside a policy and build it; raises ``ValueError`` on the first inconsistency."""
    scope = payload.get("scope", {})
    for name, values in {**{k: payload.get(k, []) for k in REQUIRED}, **{f"scope.{k}": v for k, v in scope.items()}}.items():
        if len(values) != len(set(values)):
            raise ValueError(f"{name} must not contain duplicates")
    clash = set(scope.get("supported_jobs", ())) & set(scope.get("prohibited_jobs", ()))
    if clash:
        raise ValueError(f"supported and prohibited jobs overlap: {sorted(clash)}")
    for name, wanted in REQUIRED.items():
        if wanted - set(payload.get(name, ())):
            raise ValueError(f"{name} lacks {sorted(wanted - set(payload.get(name, ())))}")
    sources, fields, changes = payload["sources"], payload["fields"], payload["change_types"]
    if not (sources and fields and changes):
        raise ValueError("sources, fields and change_types must not be empty")
    for name, field in fields.items():
        unknown = set(field["preferred_sources"]) - set(sources)
        if unknown:
            raise ValueError(f"{name} references unknown sources: {sorted(unknown)}")
        if field["conflict_resolution"] not in RESOLUTIONS:
            raise ValueError(f"{name} has an unknown conflict resolution")
        if field["conflict_resolution"] == "authoritative_first" and not sources[field["preferred_sources"][0]]["authoritative"]:
            raise ValueError(f"{name} prefers a source that is not authoritative")
    for name, change in changes.items():
        if change["tracked_field"] is not None and change["tracked_field"] not in fields:
            raise ValueError(f"{name} references unknown field {change['tracked_field']}")
    return Policy(payload["policy_version"], sources, fields, changes, tuple(payload["verification_statuses"]))


def load_policy(path: str | Path = DEFAULT_PATH) -> Policy:
    return parse_policy(json.loads(Path(path).read_text(encoding="utf-8")))
