"""The thin queries over the operators: one ``opN_<name>`` each, SQL where it can be stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    conversation_repair,
    credentials,
    exact_stream,
    filter_audit,
    grammar,
    langid,
    mixing,
    ngram_join,
    outliers,
    packing,
    quality_gbt,
    simhash,
    toxicity,
)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query(
    "op1_exact_dedup",
    r"""WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_stream.deduplicate(documents(spark, sf_dir)).drop("row")


@query("op7_simhash")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op9_mixing")
def mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op5_packing")
def length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def fold(folds: int) -> Column:
    """crc32 of the id as text, by ``folds``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


@query("op4_language")
def language_by_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    docs = documents(spark, sf_dir).withColumn("held_out", held_out)
    return langid.identify(docs, langid.train(docs, ~F.col("held_out")), ["doc_id", "held_out"])


@query("op10_quality")
def quality_by_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = quality_gbt.train(docs, labels, ~F.col("held_out"))
    return quality_gbt.score(docs, forest, ["doc_id", "held_out"])


@query("op2_toxicity")
def toxicity_of_restored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.character_model(docs)
    learned = toxicity.train(docs, labels, ~F.col("held_out"), model)
    return toxicity.score(docs, model, learned, ["doc_id", "held_out"])


@query("op8_secrets")
def secrets_by_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(documents(spark, sf_dir))


@query("op6_outliers")
def robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir))


@query("op3_token_grammar")
def tokens_as_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return grammar.store(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op11_filter_audit",
    r"""WITH letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, l, bit,
    CAST(coalesce((SELECT sum(p.bit) FROM letters p WHERE strpos(substr(filter_order, 1, step - 1), p.l) > 0), 0) AS INTEGER) AS before
  FROM orders, (VALUES (1), (2), (3), (4), (5)) s(step), letters WHERE l = substr(filter_order, step, 1)),
marks AS (
  SELECT doc_id AS id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN marks ON id = doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f GROUP BY part, mask),
counted AS (
  SELECT part, filter_order, step, l,
    CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, l)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley
FROM counted""",
)
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# A conversation's rows are folded in SQL as well. A state is one text there: nine digits of cost, the
# audit, \\x01, the repaired lines; the least text is the cheapest sequence with the least audit.
def _edited(state: str, cost: str, letter: str, line: str) -> str:
    parts = f"substr({state}, 10)"
    grown = f"lpad(CAST(CAST(substr({state}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || split_part({parts}, chr(1), 1)"
    return f"CASE WHEN {state}[1] = '9' THEN '999999999' ELSE {grown} || '{letter}' || chr(1) || split_part({parts}, chr(1), 2) || {line} END"


def _row_in_sql() -> str:
    late = "CASE WHEN r[3] = 't' THEN 3 ELSE 0 END"
    kept = "chr(10) || r[1] || ':' || r[2]"

    def to(state: int, initial: str, role: str | None, *origins: int) -> str:
        moves = [_edited(f"acc[{state}]", "4", "D", "''")]
        for o in origins:
            keep = _edited(f"acc[{o}]", late, "K", kept)
            moves.append(f"CASE WHEN r[3] IN ('', 't') AND substr(r[1], 1, 1) = '{initial}' THEN {keep} ELSE '999999999' END")
            if role:
                turned = _edited(f"acc[{o}]", f"3 + {late}", "R", f"chr(10) || '{role}:' || r[2]")
                moves.append(f"CASE WHEN r[3] IN ('', 't') THEN {turned} ELSE '999999999' END")
        return f"least({', '.join(moves)}, '999999999')"

    moved = f"[{to(1, '', None)}, {to(2, 's', None, 1)}, {to(3, 'u', 'user', 1, 2, 4)}, {to(4, 'a', 'assistant', 3)}]"
    inserted = ", ".join(_edited(f"n[{o}]", "3", "I", "chr(10) || 'user:'") for o in (1, 2, 4))
    users = f"list_transform([{moved}], lambda n: [n[1], n[2], least(n[3], {inserted}), n[4]])"
    answer = _edited("n[3]", "3", "I", "chr(10) || 'assistant:'")
    return f"list_transform({users}, lambda n: [n[1], n[2], n[3], least(n[4], {answer})])[1]"


@query(
    "op13_conversation_repair",
    rf"""WITH k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations),
c AS (
  SELECT *, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda acc, byte: list_reduce(
      [xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS kind
  FROM k),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS earlier
  FROM d),
m AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' 
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault
  FROM o),
p AS (
  SELECT conv_id, list([role, text, fault] ORDER BY place) AS held,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE earlier || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM m GROUP BY conv_id),
f AS (
  SELECT *, list_reduce(list_prepend(
    ['000000000' || chr(1), '999999999', '000000003I' || chr(1) || chr(10) || 'user:',
     '000000006II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:'], held),
    lambda acc, r: {_row_in_sql()}) AS states
  FROM p),
e AS (SELECT *, least(states[1], states[4]) AS best FROM f)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(substr(best, 1, 9), '0') AS BIGINT) AS cost, coalesce(split_part(substr(best, 10), chr(1), 1), '') AS audit,
  sha256(coalesce(substr(split_part(best, chr(1), 2), 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id""",
)
def conversations_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(rows, rows["copies"])


@query(
    "op12_ngram_join",
    r"""WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT id, doc_id, CASE WHEN len(w) >= 5
    THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS own
  FROM t),
u AS (SELECT id, len(own) AS n, unnest(own) AS shingle FROM s),
p AS (
  SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.shingle = b.shingle AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT id AS x, id AS y FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, len(s.own) AS n_shingles, c.component_id FROM s JOIN (
  SELECT r.x, min(o.doc_id) AS component_id FROM r JOIN s o ON o.id = r.y GROUP BY r.x) c ON c.x = s.id""",
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))
