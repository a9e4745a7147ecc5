"""What each filter of a chain removes, for every order of the chain.

Documents count only by the set of filters that they fail (their mask), so all
orders follow from the counts of at most 2**k masks a part.  Let ``fails`` be
the matrix of masks by filters with 0 where the mask fails the filter and
infinity elsewhere, and ``position`` the matrix of orders by filters with the
step at which the order applies the filter (the inverse permutation).  Their
min-plus product is the step that removes the documents of a mask under an
order; scattering the masks' counts to those steps gives the removals.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache, reduce
from itertools import permutations
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, written

NAMES = "ABCDE"  # the filters of ``document_masks``
MIN_WORDS = 100
MIN_DISTINCT = 80  # percent of the words
MAX_CAPITALS = 10  # percent of the characters
SIGNS = r"[#$%&*|]"

_NEVER = np.iinfo(np.int64).max // 4


@lru_cache(maxsize=4)
def orders(k: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of k filters, and for each the steps 1 to k of its filters."""
    order = np.array(list(permutations(range(k))), np.int64)
    position = np.empty_like(order)
    np.put_along_axis(position, order, np.arange(1, k + 1)[None, :], axis=1)
    return order, position


def removal_steps(masks: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Masks by orders: the step that removes a mask's documents, one beyond
    the last if none does.  Bit f of a mask says that filter f fails."""
    k = position.shape[1]
    fails = np.where(masks[:, None] >> np.arange(k) & 1, 0, _NEVER)
    return np.minimum((fails[:, None, :] + position[None, :, :]).min(axis=2), k + 1)


def audit(masks: np.ndarray, weights: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """Counts by order and step; ``weights``: kinds by masks, all documents first."""
    order, position = orders(k)
    step = removal_steps(masks, position)
    out = np.zeros((len(weights), len(order), k + 2), np.int64)
    at = np.broadcast_to(np.arange(len(order)), step.shape)
    for kind, weight in zip(out, weights):
        np.add.at(kind, (at, step), weight[:, None])
    removed = out[:, :, 1 : k + 1]
    bit = masks[:, None] >> np.arange(k) & 1
    failing = weights[0] @ bit
    alone = weights[0] @ np.where(masks[:, None] == 1 << np.arange(k), 1, 0)
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, order, removed[0])
    return {
        "kept": weights[0].sum() - np.cumsum(removed[0], axis=1),
        "removed": removed[0],
        "redundant": failing[order] - removed[0],
        "unique_fails": alone[order],
        **{f"lost {i}": x for i, x in enumerate(removed[1:])},
        "shapley": shapley[order],
    }


def _audited(batches: Iterator[pa.RecordBatch], names: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """All rows of the parts, each given as its masks and their counts."""
    k = len(names)
    order, _ = orders(k)
    spelled = np.array(["".join(names[f] for f in o) for o in order])
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            masks = np.array([c["mask"] for c in counts], np.int64)
            weights = np.array([c["weights"] for c in counts], np.int64).T
            found = audit(masks, weights, k)
            n = order.size
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.string()), pa.array(np.repeat(spelled, k).tolist(), pa.string()),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(order))),
                 *[pa.array(np.ascontiguousarray(x).reshape(-1)) for x in found.values()]],
                names=["part", "filter_order", "step", *columns],
            )


def order_audit(rows: DataFrame, names: str, lost: Mapping[str, Column]) -> DataFrame:
    """The audit of a chain of filters, named by one letter each (8 at most).

    ``rows`` has one row per document with part (string) and mask (int; bit f:
    the document fails filter f).  ``lost`` names further counts and the
    condition under which a document is among them.  Returns one row per part,
    order and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, one column for each of ``lost``, shapley.
    """
    if len(names) > 8:
        raise ValueError("orders of more than 8 filters are too many to list")
    weights = [F.count("*"), *[F.count(F.when(c, 1)) for c in lost.values()]]
    masks = rows.groupBy("part", "mask").agg(F.array(*weights).alias("weights"))
    # at most 2**len(names) rows a part
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "weights")).alias("counts"))
    columns = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns)
    return map_arrow(parts, lambda it: _audited(it, names, columns), schema)


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang, empty for null) and mask of every document under the
    filters A (few words), B (few distinct words), C (capitals), D (signs) and
    E (a smaller doc_id has the same text).

    A null text is empty.  A null doc_id is neither smaller nor larger than
    another; rows that repeat a doc_id and its text do not fail E by each other.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    own = [
        F.col("n") < MIN_WORDS,
        F.col("distinct") * 100 < F.col("n") * MIN_DISTINCT,
        capitals * 100 > F.length(text) * MAX_CAPITALS,
        text.rlike(SIGNS),
    ]
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        "text", words.alias("words"),
    ).select(
        "doc_id", "part", "text", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct"),
    )
    judged = written(
        judged.select(
            "doc_id", "part", F.unhex(F.sha2(text.cast("binary"), 256)).alias("mark"),
            reduce(add, [F.when(c, 1 << f).otherwise(0) for f, c in enumerate(own)]).alias("own"),
        ),
        "filter-masks",
    )
    # texts of one document need no partner
    leads = judged.groupBy(F.col("mark").alias("of")).agg(F.min("doc_id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    # written, so that the join's sides are plain shuffles, of which Spark can split a hot text's
    leads = written(leads, "filter-leads")
    copy = F.coalesce(F.col("doc_id") > F.col("lead"), F.lit(False))
    return judged.join(leads, F.col("mark") == F.col("of"), "left").select(
        "doc_id", "part", (F.col("own") + F.when(copy, 1 << 4).otherwise(0)).alias("mask")
    )


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_audit`` of the five document filters by language.

    ``docs`` needs doc_id, text and lang, ``labels`` doc_id, quality and toxic;
    other columns are ignored.  A document counts as good (toxic) if any row of
    ``labels`` with its doc_id has quality (toxic) 1; null labels count as 0.
    Rows that repeat a doc_id count each.  An empty table gives an empty result.
    """
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"),
    ).where("good or bad")
    rows = document_masks(docs).join(marked, F.col("doc_id") == F.col("of"), "left")
    return order_audit(rows, NAMES, {"good_lost": F.col("good"), "toxic_lost": F.col("bad")})


_FILTERS = [f"'{c}'" for c in NAMES]

# The same audit by plain SQL: every mask under every order.
AUDIT_SQL = f"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), words AS (
    SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
           min(doc_id) OVER (PARTITION BY t) AS lead
    FROM texts
), marked AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id
), judged AS (
    SELECT part,
           len(w) < {MIN_WORDS} AS a,
           100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t) AS c,
           regexp_matches(t, '{SIGNS}') AS d,
           coalesce(words.doc_id > lead, false) AS e,
           coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
    FROM words LEFT JOIN marked ON words.doc_id = marked.doc_id
), masks AS (
    SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(bad) AS bad
    FROM judged GROUP BY part, a, b, c, d, e
), letters AS (
    SELECT unnest([{", ".join(_FILTERS)}]) AS f
), sequences AS (
    SELECT v.f || w.f || x.f || y.f || z.f AS filter_order
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE v.f <> w.f AND v.f <> x.f AND v.f <> y.f AND v.f <> z.f AND w.f <> x.f AND w.f <> y.f AND w.f <> z.f
      AND x.f <> y.f AND x.f <> z.f AND y.f <> z.f
), ranked AS (
    SELECT part, filter_order, n, good, bad,
           a AS fa, b AS fb, c AS fc, d AS fd, e AS fe,
           least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
                 CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
                 CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS gone
    FROM masks, sequences
), steps AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS step
), flagged AS (
    SELECT part, filter_order, step, n, good, bad, gone,
           substr(filter_order, step, 1) AS filter,
           CASE substr(filter_order, step, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS fails,
           fa::int + fb::int + fc::int + fd::int + fe::int AS failed
    FROM ranked, steps
), counted AS (
    SELECT part, filter_order, step, filter,
           sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone < step AND fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails AND failed = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN gone = step THEN bad ELSE 0 END) AS toxic_lost
    FROM flagged GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed,
       redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
       good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley
FROM counted
"""
