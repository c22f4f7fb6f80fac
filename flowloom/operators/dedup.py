"""Near-duplicate workflows by weighted Jaccard similarity of four feature sets.

``features``: doc, kind (trigger, job, use, run), token. Similarities are 32-bit floats,
summed in the order of WEIGHTS, and two empty sets count as equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.lineage import cut
from flowloom.operators import graph

# Kinds and weights, in the order in which they are added.
WEIGHTS = (("trigger", 0.15), ("job", 0.10), ("use", 0.40), ("run", 0.35))
# Documents on a token's list, above which they meet by rarer tokens of other kinds.
LONG = 100


def sets_of(features: DataFrame) -> DataFrame:
    """One row for each document with a sorted set for each kind."""
    return features.groupBy("doc").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("token")))).alias(kind) for kind, _ in WEIGHTS])


def _hash(token):
    """64 bits of a token: two sets of n and m tokens hold a pair that only looks equal with a chance of n * m / 2^64."""
    return F.xxhash64(token)


def hashed(features: DataFrame) -> DataFrame:
    """``sets_of`` with a hash for each token: only the hashes move."""
    return features.select("doc", "kind", _hash(F.col("token")).alias("token")).groupBy("doc").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("token")))).alias(kind) for kind, _ in WEIGHTS])


def hashed_rows(docs: DataFrame, tokens: dict) -> DataFrame:
    """``hashed`` of documents that hold all their tokens in one row: ``docs`` has a column ``doc``, ``tokens`` an array for each kind.

    Nothing moves if every document has one row; the rows of repeated ones are merged.
    Documents with a null array or without any token are left out, as features have none of them.
    """
    rows = docs.select("doc", *[F.array_sort(F.array_distinct(F.transform(tokens[kind], _hash))).alias(kind) for kind, _ in WEIGHTS])
    rows = rows.where(" + ".join(f"if({kind} is null, null, size({kind}))" for kind, _ in WEIGHTS) + " > 0")
    if not docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy("doc").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(kind)))).alias(kind) for kind, _ in WEIGHTS])
    return rows


def similarity(x: str, y: str):
    total = None
    for kind, weight in WEIGHTS:
        a, b = F.col(f"{x}.{kind}"), F.col(f"{y}.{kind}")
        both = F.size(F.array_intersect(a, b))
        union = F.size(a) + F.size(b) - both
        j = F.when(union == 0, F.lit(1.0).cast("float")).otherwise((both / union).cast("float"))
        term = F.lit(weight).cast("float") * j
        total = term if total is None else total + term
    return total.cast("float")


def _weighted(kind: str, weight: float):
    """A kind's tokens with what each counts; an empty set is one token (null) that counts all."""
    tokens = F.when(F.size(kind) > 0, F.col(kind)).otherwise(F.array(F.lit(None).cast("bigint")))
    counts = F.lit(weight) / F.greatest(F.size(kind), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(F.xxhash64(F.lit(kind), t.isNull(), t).alias("token"), counts.alias("counts")))


def _prefix(sets: DataFrame, kinds: tuple, least: float) -> DataFrame:
    """Of each document the shared tokens of ``kinds``, the rarest first, behind which (with themselves, and all that other kinds count) ``least`` is left: doc, token, df."""
    other = sum(w for k, w in WEIGHTS if (k, w) not in kinds)
    tokens = sets.select("doc", F.inline(F.concat(*[_weighted(k, w) for k, w in kinds])))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    left = F.lit(other) + F.sum("counts").over(Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0))
    return tokens.join(common, "token").withColumn("left", left).where(F.col("left") >= least).select("doc", "token", "df")


def _met(prefix: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Pairs a < b that share a token of their prefixes, if the sizes of their sets allow ``least``."""
    sized = prefix.select("doc", "token").join(sizes, "doc")
    x, y = (sized.select(F.col("doc").alias(d), "token", *[F.col(k).alias(f"{d}_{k}") for k, _ in WEIGHTS]) for d in "ab")
    most = lambda k, w: F.when(F.greatest(f"a_{k}", f"b_{k}") == 0, w).otherwise(w * F.least(f"a_{k}", f"b_{k}") / F.greatest(f"a_{k}", f"b_{k}"))
    allowed = sum((most(k, w) for k, w in WEIGHTS[1:]), most(*WEIGHTS[0])) >= least
    return x.join(y, "token").where((F.col("a") < F.col("b")) & allowed).select("a", "b")


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the similarity of their whole sets."""
    full = pairs.join(sets.alias("x"), F.col("a") == F.col("x.doc")).join(sets.alias("y"), F.col("b") == F.col("y.doc"))
    return full.select("a", "b", similarity("x", "y").alias("similarity"))


def similar_classes(given: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, sets): documents of equal sets are one class, named by its smallest document; pairs a < b are of classes
    of similarity ``threshold`` or more, any threshold above 0; members: doc, rep; sets: of all documents, hashed.

    ``given``: features, or sets as ``hashed_rows`` gives them.

    A token of a kind counts its weight by the size of the document's set of that kind, and
    an empty set is one token with the whole weight; then a pair shares tokens that count
    the threshold at least, for each of the two. So of each document's shared tokens, the rarest first,
    only those matter behind which (with themselves) that much is left: the rarest one that
    a pair shares is among them for both. That holds in any order of tokens. Where no pair reaches the threshold
    without its heaviest kind, all other tokens are taken for more common than that kind's, count in full and needn't move.
    Documents whose prefix has a list of more than LONG then meet again by the tokens of all kinds, among which common ones give way to
    rarer ones; a pair with a shorter list in common is found there, and both of any other pair are such documents.
    Pairs that meet are cut by what the sizes of their sets allow, and verified on the whole sets.
    """
    if threshold <= 0:
        raise ValueError("all documents are similar to degree 0")
    least = threshold - 1e-6
    kinds = [k for k, _ in WEIGHTS]
    sets = (hashed(given) if "kind" in given.columns else given).where("doc is not null")
    whole = cut(sets.withColumn("same", F.sha2(F.to_json(F.struct(*kinds)), 256)))
    sets = whole.drop("same")
    members = cut(whole.select("doc", "same").join(whole.groupBy("same").agg(F.min("doc").alias("rep")), "same").select("doc", "rep"))
    reps = members.where("doc = rep").select("doc")
    sizes = whole.select("doc", *[F.size(k).alias(k) for k in kinds])
    heavy = max(WEIGHTS, key=lambda k: k[1])
    if sum(w for _, w in WEIGHTS) - heavy[1] < least:
        first = cut(_prefix(sets.select("doc", heavy[0]).join(reps, "doc", "left_semi"), (heavy,), least))
        pairs = _met(first.where(F.col("df") <= LONG), sizes, least)
        again = cut(first.where(F.col("df") > LONG).select("doc").distinct())
    else:
        pairs, again = None, reps
    if pairs is None or not again.isEmpty():
        rest = _met(cut(_prefix(sets.join(again, "doc", "left_semi"), WEIGHTS, least)), sizes, least)
        pairs = rest if pairs is None else pairs.unionByName(rest)
    found = _scored(pairs.distinct(), sets).where(F.col("similarity") >= F.lit(threshold).cast("float"))
    return cut(found), members, sets


def equal_similarity(threshold: float):
    """The similarity of equal sets, as a column over (doc, rep) rows; null if that is less than ``threshold``."""
    total = None
    for _, weight in WEIGHTS:
        term = F.lit(weight).cast("float") * F.lit(1.0).cast("float")
        total = term if total is None else total + term
    return F.when(total.cast("float") >= F.lit(threshold).cast("float"), total.cast("float"))


def similar_pairs(given: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs a < b of documents of similarity ``threshold`` or more, with it: what ``similar_classes`` finds, for all members."""
    pairs, members, _ = similar_classes(given, threshold)
    x, y = (members.select(F.col("doc").alias(f"{d}_doc"), F.col("rep").alias(d)) for d in "ab")
    ends = [F.least("a_doc", "b_doc").alias("a"), F.greatest("a_doc", "b_doc").alias("b")]
    between = pairs.join(x, "a").join(y, "b").select(*ends, "similarity")
    within = x.join(y, F.col("a") == F.col("b")).where("a_doc < b_doc").select(*ends, equal_similarity(threshold).alias("similarity")).where("similarity is not null")
    return between.unionByName(within)


def clustered(given: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, sets): members of clusters of two documents and more, found on classes: representative (smallest document), doc,
    similarity to the representative, rep (the doc's class); sets: the hashed sets of all documents.

    Copies of a document are never paired with each other, and what a class has is found once.
    """
    pairs, members, sets = similar_classes(given, threshold)
    roots = graph.components(pairs.select("a", "b"))
    ends = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    known = pairs.join(ends, ["a", "b"], "left_semi").select("a", "b", "similarity")
    far = cut(known.unionByName(_scored(ends.join(pairs, ["a", "b"], "left_anti"), sets)))
    same = equal_similarity(0.0)
    copied = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").where(equal_similarity(threshold).isNotNull()).select("rep")
    near = roots.where("node = root").select(F.col("root").alias("rep")).union(copied.join(roots.select(F.col("node").alias("rep")), "rep", "left_anti"))
    classes = near.select(F.col("rep").alias("representative"), "rep", same.alias("similarity")).union(far.select("a", "b", "similarity"))
    return members.join(classes, "rep").select("representative", "doc", "similarity", "rep"), sets


def similar_clusters(given: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Clusters of two and more: representative (smallest document), doc, and its similarity to the representative."""
    return clustered(given, threshold)[0].drop("rep")


def numbered(members: DataFrame) -> DataFrame:
    """Members with ``cluster``, the place of their representative among all, from 0.

    Representatives are dealt over tasks by range; only the sizes of the ranges meet in one task.
    """
    ranged = cut(members.select("representative").distinct().repartitionByRange("representative").withColumn("range", F.spark_partition_id()))
    ahead = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("range").orderBy("representative")) - 1
    return members.join(ranged.join(sizes, "range").select("representative", place.alias("cluster")), "representative")


def uses_by_cluster(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Hashed tokens of ``use`` in a cluster, and if all its documents have them; both as ``clustered`` gives them."""
    classes = members.groupBy("representative", "rep").agg(F.count(F.lit(1)).alias("n"))
    sizes = classes.groupBy("representative").agg(F.sum("n").alias("size"))
    uses = sets.select(F.col("doc").alias("rep"), F.col("use")).join(classes, "rep").select("representative", "n", F.explode("use").alias("token"))
    counts = uses.groupBy("representative", "token").agg(F.sum("n").alias("n"))
    return counts.join(sizes, "representative").select("representative", "token", (F.col("n") == F.col("size")).alias("common"))
