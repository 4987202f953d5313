"""Problem 4: the same or nearly the same records across splits, with a count for each split and source.

The similarity hash of a text is the set of bits its words switch on, words being longest runs of letters and
digits in lower case. Texts of both sides are joined by ``setjoin.similar_sets``: codes are permuted so that bits of rare
words come first, joined on blocks of one or two leading bits, filtered by 64-bit fingerprints within their Hamming
radius, and verified on whole word sets; no pair within the radius is missed.

The dealt scheme, blocks of a code of fixed length joined across splits, can't give every pair here: two texts that share
0.8 of their union may differ in a quarter of their words, so a text of 50 words needs 13 segments for one to be alike,
of four words each, and most of these are frequent ones. See the README for the figures.

The report counts on classes - texts of equal word sets, message_ids of equal groups - and never expands a pair of
classes to pairs of rows.

Edge cases: null texts and texts without words have no links by text; rows without a split take no part;
split names are compared in lower case without blanks; texts with the same words are handled once and expanded
over their rows; null message_id and dup_group tie nothing; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import setjoin
from ..session import checkpointed

SIMILAR = 0.8
#: Blocks of two bits for texts of up to 128 words, of one beyond.
PAIR_LEAD = 27


def words(text: Column) -> Column:
    """The words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sides(combined: DataFrame) -> DataFrame:
    """Rows of combined that have a split: id, message_id, side, split_name, source."""
    split = F.lower(F.trim("split_name"))
    source = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_"), F.lit("unknown"))
    out = combined.select(F.col("row_id").alias("id"), "message_id", split.alias("split_name"), source.alias("source"))
    return out.where(F.col("split_name").isin("train", "valid", "test")).withColumn("side", F.when(F.col("split_name") == "train", "train").otherwise("eval"))


def text_classes(rows: DataFrame, messages: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(id, side, rep) of the rows that have words, and the pairs (rep_eval, rep_train) of similar texts."""
    text = messages.select(F.col("row_id").alias("id"), F.col("body").alias("text"))
    sets, member = setjoin.distinct_sets(rows.select("id", "side").join(text, "id"), "id", words(F.col("text")), "side")
    pairs = setjoin.similar_sets(sets, similar, strict=False, side=("side", "eval", "train"), pair_lead=PAIR_LEAD)
    return member, pairs.select(F.col("a").alias("rep_eval"), F.col("b").alias("rep_train"))


def group_sets(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, groups: the dup_groups of each row's message_id in the corpus, sorted; rows without any are left out."""
    groups = corpus.where("dup_group is not null and message_id is not null").groupBy("message_id").agg(F.array_sort(F.collect_set("dup_group")).alias("groups"))
    return rows.select("id", "message_id").join(groups, "message_id").select("id", "groups")


def cross_split_overlaps(combined: DataFrame, messages: DataFrame, corpus: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """id_eval, id_train of rows of combined, by similar text or by a common dup_group; each pair once."""
    rows = sides(combined)
    member, pairs = text_classes(rows, messages, similar)
    own = lambda side: member.where(F.col("side") == side).select(F.col("rep").alias(f"rep_{side}"), F.col("id").alias(f"id_{side}"))
    by_text = pairs.join(own("eval"), "rep_eval").join(own("train"), "rep_train").select("id_eval", "id_train")
    groups = corpus.where("dup_group is not null and message_id is not null").select("message_id", "dup_group").distinct()
    tied = checkpointed(rows.select("id", "side", "message_id").join(groups, "message_id").select("id", "side", "dup_group"))
    of = lambda side: tied.where(F.col("side") == side).select("dup_group", F.col("id").alias(f"id_{side}"))
    return by_text.unionByName(of("eval").join(of("train"), "dup_group").select("id_eval", "id_train")).distinct()


def overlap_report(combined: DataFrame, messages: DataFrame, corpus: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Per split and source of the evaluation rows: rows, rows with an overlap, pairs.

    Rows of one text class and one set of groups count together. A row's pairs are those by text plus those by group less
    those by both, each a sum of class counts.
    """
    rows = checkpointed(sides(combined))
    member, pairs = text_classes(rows, messages, similar)
    pairs = checkpointed(pairs)
    named = rows.join(member.select("id", "rep"), "id", "left").join(group_sets(rows, corpus), "id", "left")
    classes = checkpointed(named.groupBy("side", "rep", "groups", F.when(F.col("side") == "eval", F.col("split_name")).alias("split_name"), F.when(F.col("side") == "eval", F.col("source")).alias("source")).agg(F.count("*").alias("n")))
    own, train = classes.where("side = 'eval'").drop("side"), classes.where("side = 'train'").select(F.col("rep").alias("rep_train"), F.col("groups").alias("groups_train"), F.col("n").alias("m"))
    by_text = pairs.join(train.groupBy("rep_train").agg(F.sum("m").alias("m")), "rep_train").groupBy(F.col("rep_eval").alias("rep")).agg(F.sum("m").alias("by_text"))
    each = lambda x, groups, name: x.select(groups).where(f"{groups} is not null").distinct().select(groups, F.explode(groups).alias(name))
    tied = checkpointed(each(own, "groups", "g").join(each(train, "groups_train", "g"), "g").select("groups", "groups_train").distinct())
    by_group = tied.join(train.groupBy("groups_train").agg(F.sum("m").alias("m")), "groups_train").groupBy("groups").agg(F.sum("m").alias("by_group"))
    both = own.where("rep is not null and groups is not null").select("rep", "groups").distinct()
    both = both.join(pairs, both.rep == pairs.rep_eval).join(train, "rep_train").join(tied, ["groups", "groups_train"]).groupBy("rep", "groups").agg(F.sum("m").alias("by_both"))
    out = own.join(by_text, "rep", "left").join(by_group, "groups", "left").join(both, ["rep", "groups"], "left")
    k = F.coalesce("by_text", F.lit(0)) + F.coalesce("by_group", F.lit(0)) - F.coalesce("by_both", F.lit(0))
    return out.groupBy("split_name", "source").agg(F.sum("n").alias("n_rows"), F.sum(F.when(k > 0, F.col("n")).otherwise(0)).alias("n_leaked"), F.sum(F.col("n") * k).alias("n_pairs"))
