"""What follows from drift: the ladder, widened bounds or a routed replacement, and a certificate for each request.

A certificate cites the warrant whose bounds it claims: that under observation, the replacement that routing found on
the envelope the traffic is in, or none. Routing reads statuses after the ladder, so nothing that the same windows
revoked is cited as a replacement.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warrantlake.operators import drift as D
from warrantlake.operators import matrix as X
from warrantlake.sources.shared import written

KEY = ["detector_id", "operating_point_id", "envelope_id"]
BOUNDS = ["recall", "recall_low", "recall_high", "fpr_high"]

#: What a certificate says of what it doesn't cover.
UNCHECKED = {
    "joint": "drift of several features together: each was scored by itself",
    "unobserved": "features without values in the window, not scored as stable: ",
    "smoothing": "the size of the shift: over half of the index rests on bins that one side leaves empty, in ",
    "uncovered": "anything this detector was warranted for: it is revoked, and no other holds a warrant on ",
    "off_axis": "replacements: the matrix has no envelope ",
    "widened": "whether widened bounds cover the new distribution: the factor is declared, not measured",
    "unfiled": "anything: no such warrant was ever filed",
    "moved": "bounds on the live envelope: they were measured on ",
}


@dataclass(frozen=True)
class Policy:
    """The settings of a response; ``digest`` is what a certificate cites. Bands and window are those of the verdicts."""

    psi_stable: float = D.STABLE
    psi_significant: float = D.SIGNIFICANT
    window: int = 200
    widen: float = 1.5
    min_recall: float = 0.0
    max_fpr: float = 1.0
    default: str = "ESCALATE"

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def final_verdicts(windows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The verdict of each key's last window, from the rows of ``drift.verdicts``; ``drift.last_verdicts`` makes no others."""
    told = F.struct("state", "driver", "unobserved", "driven_by_smoothing")
    return windows.groupBy(key).agg(F.max_by(told, F.struct(*order)).alias("v")).select(key, "v.*")


def respond(warrants: DataFrame, verdicts: DataFrame, stream: str, policy: Policy, wanted: DataFrame | None = None) -> DataFrame:
    """One row a warrant: its next status, what may be claimed now, on whose warrant, and the action.

    ``warrants``: KEY, ``stream``, live_envelope_id, status, expired and BOUNDS; ``verdicts``: see
    ``final_verdicts``; ``wanted``: the KEYs to answer, all without it, while routing reads every warrant. A stream without a verdict has too little data, and nothing changes. An expired warrant is
    stale at best. Stale bounds are widened by the declared factor; a revoked warrant claims its replacement's
    bounds, unwidened, or none; a refused one claims nothing. A live envelope that isn't in the matrix is told apart
    from one where no warrant qualifies.
    """
    x = warrants.join(verdicts, stream, "left").withColumn("state", F.coalesce("state", F.lit("INSUFFICIENT_DATA")))
    next_ = D.ladder(F.col("status"), F.col("state"))
    moved = x.withColumn("after", F.when(F.col("expired") & (next_ == "VALID"), "STALE").otherwise(next_))
    moved = written(moved.withColumnsRenamed({"status": "before"}), "moved")

    cells = moved.select(*KEY, *BOUNDS, F.col("after").alias("status"))
    best = X.route(cells, policy.min_recall, policy.max_fpr)
    taken = cells.drop("status").join(F.broadcast(best.select(*KEY)), KEY)
    r = best.join(taken, KEY, "left").select(F.col("envelope_id").alias("live_envelope_id"), F.lit(True).alias("on_axis"), "considered", F.when(F.col("operating_point_id").isNotNull(), F.struct("detector_id", "operating_point_id", "envelope_id", *BOUNDS)).alias("other"))
    asked = moved if wanted is None else moved.join(wanted.select(*KEY), KEY, "left_semi")
    x = asked.join(F.broadcast(r), "live_envelope_id", "left")

    revoked, stale = F.col("after") == "REVOKED", F.col("after") == "STALE"
    routed = revoked & F.col("other").isNotNull()
    own = F.col("after").isin("VALID", "STALE")
    factor = F.when(stale, policy.widen).otherwise(1.0)
    spread = lambda c: F.col("recall") + (F.col(c) - F.col("recall")) * factor
    mine = {"recall": F.col("recall"), "recall_low": spread("recall_low"), "recall_high": spread("recall_high"), "fpr_high": F.col("fpr_high")}
    claimed = {f"claimed_{c}": F.when(own, v).when(routed, F.col(f"other.{c}")) for c, v in mine.items()}
    cited = F.when(own, F.concat_ws("|", *KEY)).when(routed, F.concat_ws("|", *(F.col(f"other.{c}") for c in KEY)))
    action = F.when(F.col("after") == "VALID", "ALLOW").when(routed, "ALLOW").when(revoked, policy.default).otherwise("ESCALATE")
    say = lambda name, *more: F.concat(F.lit(UNCHECKED[name]), *more)
    notes = F.array_compact(
        F.array(
            say("joint"),
            F.when(F.size("unobserved") > 0, say("unobserved", F.array_join(F.array_sort("unobserved"), ", "))),
            F.when(F.col("driven_by_smoothing"), say("smoothing", F.col("driver"))),
            F.when(revoked & F.col("on_axis").isNull(), say("off_axis", F.col("live_envelope_id"))),
            F.when(revoked & F.col("on_axis") & ~routed, say("uncovered", F.col("live_envelope_id"))),
            F.when(stale, say("widened")),
            F.when(own & (F.col("live_envelope_id") != F.col("envelope_id")), say("moved", F.col("envelope_id"))),
        )
    )
    told = {"cited": cited, "weakest": F.when(routed, "VALID").otherwise(F.col("after")), "action": action, "considered": F.when(revoked, F.coalesce("considered", F.lit(0))), "unchecked": notes}
    return x.withColumns(claimed | told).select(*KEY, stream, "live_envelope_id", "before", "state", "driver", "after", "cited", "weakest", "action", "considered", *claimed, "unchecked")


def certify(requests: DataFrame, responses: DataFrame, policy: Policy) -> DataFrame:
    """One certificate a request (request_id, session_id, decided_at, elapsed, budget, KEY) from its warrant's response.

    A request on a warrant that was never filed cites nothing and takes the default action. An overrun of the
    budget is recorded, and changes no decision.
    """
    facts = responses.select(*KEY, "live_envelope_id", "state", "driver", "cited", "weakest", "action", *(f"claimed_{c}" for c in BOUNDS), "unchecked", F.lit(True).alias("filed"))
    x = requests.join(facts, KEY, "left")
    filed: Column = F.coalesce("filed", F.lit(False))
    rule = F.when(filed, F.concat(F.lit("ladder-"), F.col("state"))).otherwise("ladder-UNFILED")
    out = x.withColumns(
        {
            "rule_id": rule,
            "triggered_by": F.when(filed, F.concat(F.lit("envelope:"), F.col("state"))).otherwise("envelope:none"),
            "warrants_relied_upon": F.array_compact(F.array("cited")),
            "weakest": F.coalesce("weakest", F.lit("UNVALIDATED")),
            "action": F.when(filed, F.col("action")).otherwise(policy.default),
            "unchecked": F.when(filed, F.col("unchecked")).otherwise(F.array(F.lit(UNCHECKED["unfiled"]))),
            "over_budget": F.coalesce(F.col("elapsed") > F.col("budget"), F.lit(False)),
            "policy_hash": F.lit(policy.digest),
        }
    )
    identity = F.concat_ws("|", F.col("request_id").cast("string"), *KEY, "rule_id", "policy_hash")
    return out.withColumn("certificate_id", F.sha2(identity, 256)).select("certificate_id", "request_id", "session_id", "decided_at", "warrants_relied_upon", "weakest", "action", "triggered_by", "rule_id", "live_envelope_id", "driver", *(f"claimed_{c}" for c in BOUNDS), "unchecked", "over_budget", "policy_hash")
