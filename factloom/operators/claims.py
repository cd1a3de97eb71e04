"""Checks of structured claims against the fact store, as joins of canonical values and cited evidence.

A claim says which values a field of a subject has and cites evidence. It holds when every leg holds: it cites evidence of the field (``citation``),
the field has facts (``field``), the claimed values are the field's values (``value``), and these facts and the cited evidence count now
(``activity``). Values are compared by the hash of their canonical text, so ``[8, "a"]`` and ``[8,"a" ]`` are one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import ids, text as tx
from factloom.operators.facts import KEY
from factloom.operators.sizes import broadcast_if_small
from factloom.operators.stages import written


def claim_checks(claims: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One verdict for each claim.

    ``claims(claim_id, KEY, values, citations)``: values as an array of JSON texts, citations as an array of evidence ids; ``facts(KEY, value_hash, is_open)``
    with every value a field has or had; ``evidence(evidence_id, KEY, is_current)``. Returns claim_id, supported, failed_leg, reason and the
    numbers that the verdict rests on. A claim that repeats a value or a citation makes it once; claims without values have no value to match.
    """
    claims = written(claims.select("claim_id", *KEY, F.array_distinct(F.coalesce("values", F.array().cast("array<string>"))).alias("values"),
                                   F.array_distinct(F.array_compact(F.coalesce("citations", F.array().cast("array<string>")))).alias("citations")))
    fields = broadcast_if_small(claims.select(*KEY).distinct())
    known = written(facts.join(fields, KEY, "left_semi").groupBy(*KEY, "value_hash").agg(F.bool_or("is_open").alias("is_open")))
    per_field = known.groupBy(*KEY).agg(F.count(F.lit(1)).alias("field_values"), F.count_if("is_open").alias("open_values"))

    # A text that is no JSON has no canonical form and equals no value.
    canonical = F.coalesce(ids.canonical_json(F.col("v"), tx.strip), F.concat(F.lit("not json: "), "v"))
    said = claims.select("claim_id", *KEY, F.explode("values").alias("v")).select("claim_id", *KEY, F.sha2(canonical, 256).alias("value_hash")).distinct()
    values = said.join(known, [*KEY, "value_hash"], "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("claimed"), F.count("is_open").alias("matched"), F.count_if("is_open").alias("matched_open"))

    cited = claims.select("claim_id", *KEY, F.explode("citations").alias("evidence_id"))
    bound = evidence.select("evidence_id", *KEY, "is_current").join(broadcast_if_small(cited.select("evidence_id").distinct()), "evidence_id", "left_semi")
    bound = bound.groupBy("evidence_id", *KEY).agg(F.bool_or("is_current").alias("is_current"))
    proofs = cited.join(bound, ["evidence_id", *KEY], "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("cited"), F.count("is_current").alias("bound"), F.count_if("is_current").alias("current"))

    j = claims.select("claim_id", *KEY).join(per_field, KEY, "left").join(values, "claim_id", "left").join(proofs, "claim_id", "left")
    numbers = ["field_values", "open_values", "claimed", "matched", "matched_open", "cited", "bound", "current"]
    j = j.fillna(0, numbers)
    reason = (F.when(F.col("cited") == 0, "missing_field_evidence").when(F.col("bound") < F.col("cited"), "citation_not_bound_to_field")
              .when(F.col("field_values") == 0, "field_not_recorded")
              .when((F.col("matched") < F.col("claimed")) | (F.col("claimed") == 0), "value_not_equal_to_structured_field")
              .when((F.col("matched_open") < F.col("claimed")), "value_no_longer_current").when(F.col("current") < F.col("cited"), "evidence_no_longer_current")
              .when(F.col("claimed") < F.col("open_values"), "value_not_equal_to_structured_field"))
    legs = {"missing_field_evidence": "citation", "citation_not_bound_to_field": "citation", "field_not_recorded": "field",
            "value_not_equal_to_structured_field": "value", "value_no_longer_current": "activity", "evidence_no_longer_current": "activity"}
    leg = F.element_at(F.create_map(*[F.lit(x) for pair in legs.items() for x in pair]), F.col("reason"))
    return j.withColumn("reason", reason).select("claim_id", *KEY, F.col("reason").isNull().alias("supported"), F.when(F.col("reason").isNotNull(), leg).alias("failed_leg"), "reason", *numbers)
