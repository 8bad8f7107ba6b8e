"""The registered queries of this folder, each with production parameters over its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import bpe, divergence, forest, langid, linededup, merkle, packing, phrases, pii, quality, rules, sharding, simhash
from roadpulse.llm.common import ascii_lower, documents


def vocabulary() -> str:
    """Where the vocabulary file is on every machine."""
    package = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(package.origin) if package else "/opt/tokenizers"
    return f"{folder}/byte_bpe_50k.json"


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return forest.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexed("bits").alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long) as n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spelled("base"), 256).alias("base_sha256"),
                        pii.spelled("spans").alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "label", "score", "kept")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", F.octet_length("text").alias("n_bytes"))
    return sharding.place(docs, "doc_id", SHARDS)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out())
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 is divisible by 5 are tampered with: A-Z of their text lower-cased."""
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in merkle.FIELDS]
    found = merkle.manifest(docs, carried={"_given": F.when(tampered, merkle.leaf_of(fields))})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("_given", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_next(documents(spark, sf_dir).select("doc_id", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir).select("lang", "source", "text"))


# Each shard's name; the table has over 500 slots for each.
SHARDS = [f"shard-{i:03d}" for i in range(128)]

REGISTRY = {f.__name__: f for f in (
    op1_forest, op2_bpe, op3_simhash, op4_pii, op5_quality, op6_rules, op7_sharding, op8_langid, op9_linededup, op10_packing,
    op11_merkle, op12_phrases, op13_divergence)}

# The SQL twin writes the rule out anew: lines, keys, the documents that hold a key, the largest of them.
ORACLE: dict[str, str] = {
    "op9_linededup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as place
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
often as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40
  group by k having count(distinct doc_id) >= 5),
judged as (
  select keyed.*, keeper is not null and keeper <> doc_id as dropped
  from keyed left join often on keyed.k = often.k)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id""",
}


# The tree level by level, written out for up to 16 ** 6 rows of a source and as many sources. SQL here has no crc32.
_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda state, byte: list_reduce(list_prepend(xor(state, byte), range(8)),
    lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree(name: str, leaves: str, levels: int = 6) -> str:
    """CTEs ``{name}0`` to ``{name}{levels}`` of (tree, place, n, digest, sib_left, sib_right)."""
    ctes = []
    for level in range(levels + 1):
        rows = leaves if level == 0 else f"""
  select tree, place // 16 as place, (n + 15) // 16 as n, sha256(string_agg(digest, '' order by place)) as digest
  from {name}{level - 1} where n > 1 group by all"""
        ctes.append(f"""{name}{level} as (
  select *, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as sib_left,
    coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as sib_right
  from ({rows}) window run as (partition by tree, place // 16 order by place))""")
    return ",\n".join(ctes)


def _top(name: str, levels: int = 6) -> str:
    return " union all ".join(f"select tree, digest from {name}{level} where n = 1" for level in range(levels + 1))


def _climb(levels: int = 6) -> str:
    """From each leaf up, level by level: what it is hashed to (here), and the siblings met."""
    steps, last = [], "start"
    for tree in ("low", "high"):
        for level in range(levels):
            joined = f"{tree}{level} t on t.tree = s.{tree}_tree and t.place = s.{tree}_place // {16 ** level} and t.n > 1"
            steps.append(f"""up_{tree}{level} as (
  select s.* exclude (here, met),
    case when t.tree is null then here else sha256(sib_left || here || sib_right) end as here,
    met || coalesce(sib_left || sib_right, '') as met
  from {last} s left join {joined})""")
            last = f"up_{tree}{level}"
    return ",\n".join(steps) + f",\nclimbed as (select * from {last})"


ORACLE["op11_merkle"] = f"""
with hashed as (
  select doc_id, coalesce('=' || source, '-') as tree, {_LEAF.format(text="text")} as digest,
    case when {_CRC} % 5 = 0 then {_LEAF.format(text=_LOWER)} end as given
  from documents),
leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as place,
    count(*) over (partition by tree) as n from hashed),
{_tree("low", "select tree, place, n, digest from leaves")},
tops as (
  select tree, digest, row_number() over (order by tree) - 1 as place, count(*) over () as n from ({_top("low")})),
{_tree("high", "select 'all' as tree, place, n, digest from tops")},
root as ({_top("high")}),
start as (
  select l.doc_id, l.digest as leaf, t.digest as subroot, l.tree as low_tree, l.place as low_place,
    'all' as high_tree, t.place as high_place, coalesce(l.given, l.digest) as here, '' as met
  from leaves l join tops t using (tree)),
{_climb()}
select doc_id, leaf, subroot, root.digest as root, sha256(met) as proof_sha256, here as folded_root,
  here = root.digest as verified
from climbed, root"""

# The stripes as plain counts, all groups against all kept terms.
ORACLE["op13_divergence"] = f"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce({_LOWER}, '') as plain from documents),
words as (
  select row, lang, source, unnest(regexp_extract_all(plain, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term from words group by all having count(distinct row) >= 30),
used as (select lang, source, term, count(*) as c from words join kept using (lang, term) group by all),
lang_used as (select lang, term, sum(c)::bigint as c from used group by all),
langs as (
  select lang, (select count(*) from kept k where k.lang = l.lang) as v,
    (select coalesce(sum(c), 0)::bigint from lang_used u where u.lang = l.lang) as n
  from (select distinct lang from docs) l),
groups as (
  select lang, source, (select coalesce(sum(c), 0)::bigint from used u where u.lang = g.lang and u.source = g.source) as n
  from (select distinct lang, source from docs) g),
shares as (
  select g.lang, g.source, k.term, coalesce(u.c, 0) as c,
    1 + (1000000000 * (coalesce(u.c, 0) + 5)::hugeint) // (g.n + 5 * l.v) as p,
    1 + (1000000000 * (a.c + 5)::hugeint) // (l.n + 5 * l.v) as q
  from groups g join langs l using (lang) join kept k using (lang) join lang_used a on a.lang = k.lang and a.term = k.term
    left join used u on u.lang = g.lang and u.source = g.source and u.term = k.term),
pairs as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(sum(abs(a.p - b.p)), 0)::bigint as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
    left join shares a on a.lang = g.lang and a.source = g.source
    left join shares b on b.lang = h.lang and b.source = h.source and b.term = a.term
  where a.term is null or b.term is not null group by all),
terms as (
  select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where c > 0 and p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
from (from pairs union all from terms) qualify part = 'pair' or rank <= 50"""
