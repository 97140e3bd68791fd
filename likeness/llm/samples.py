"""Bounded samples of labelled documents, for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of longer texts that are drawn where shorter ones are too few, at most (one text at least).
_LONG_BYTES = 16 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, eligible: Column, per_class: int, max_bytes: int, least: int = 0) -> tuple[list[str], list[int], float | None]:
    """Texts and labels, and the share of label 1 among all eligible rows, of about ``per_class`` labelled documents of each class, at most 1.5 times as many.

    Drawn by a hash of doc_id among the labelled rows for which ``eligible``
    (a condition on doc_id) holds and whose text has at most ``max_bytes``
    bytes. A label with fewer than ``least`` such texts gets longer ones up to
    that number, the shortest of them first, of 16 MB in all at most. The
    bounds hold whatever the size of the input, and the same input gives the
    same sample. Rows with a null id, text or label take no part, nor does a
    document that is labelled both ways; one labelled twice is taken once, of
    several texts of one id the first in order.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & eligible)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where(F.col("label") == F.col("other")).drop("other")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], [], None
    # texts over max_bytes fall out, so draw some more ids than texts are wanted
    turn = F.xxhash64("doc_id", F.lit(label_col))
    draw = F.lit(False)
    for label, n in counts.items():
        up_to = int(min(1.0, 1.4 * per_class / n) * 2**64) - 2**63
        draw = draw | ((F.col("label") == label) & (turn <= min(up_to, 2**63 - 1)))
    few = known.where(draw).withColumn("turn", turn)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    one = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label", "turn").agg(F.min("text").alias("text"))  # a repeated id takes one place
    rows = one.orderBy("turn", "doc_id").limit(int(3 * per_class)).select("doc_id", "label", "text").collect()
    out_t, out_l, seen, taken = [], [], set(), {0: 0, 1: 0}
    for r in rows:
        if taken[r["label"]] < 1.5 * per_class:
            seen.add(r["doc_id"])
            taken[r["label"]] += 1
            out_t.append(r["text"])
            out_l.append(r["label"])
    for label in sorted(k for k in counts if taken[k] < least):
        size = F.octet_length(F.col("text").cast("string"))
        long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size")).where(F.col("size") > max_bytes)
        found = long.join(known.where(F.col("label") == label), "doc_id").groupBy("doc_id").agg(F.min("size").alias("size")).orderBy("size", "doc_id").limit(2 * least).collect()
        ids, held = {}, 0
        for r in found:
            if r["doc_id"] not in seen and taken[label] + len(ids) < least and (not ids or held + r["size"] <= _LONG_BYTES):
                ids[r["doc_id"]] = r["size"]
                held += r["size"]
        if ids:
            own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isin([*ids]) & (F.octet_length("text") > max_bytes))
            best = own.groupBy("doc_id").agg(F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text")).collect()
            for r in sorted(best, key=lambda r: r["doc_id"]):
                seen.add(r["doc_id"])
                out_t.append(r["text"])
                out_l.append(label)
    return out_t, out_l, counts.get(1, 0) / sum(counts.values())
