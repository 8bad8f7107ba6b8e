"""Personal data by fixed patterns, and by patterns that those finds induce.

The fixed patterns are the seeds. Numbers in a text stand in runs of blank-separated tokens; every row of tokens up to
the length of the longest seed is a candidate (a long run is cut every ``CUT`` tokens, and candidates go on over a cut). A
candidate's lexical patterns are its shape (each digit as 9), its shape after the word to its left and, if it is a whole
run, its context alone: the word to its left, the word to its right, and both. By those an identifier of a form that no
seed has is found where seeds stand. Pattern and value form a graph: a pattern's confidence
for a kind is the mean score of the values it is seen with, a value's score is 1 if a seed has
it, else the best confidence of its patterns, and 0 if it fails the kind's own test. After some rounds, candidates of
patterns of high confidence that overlap no seed are added. So a card number is found that a phone pattern
swallowed, or a number beside known ones that no fixed pattern reaches.

All of it is DataFrame expressions; patterns are possessive where that changes no match, so that no
text makes them slow or deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.once import with_once
from roadpulse.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
# A run of local characters is tried from its start, or from where the last match ended.
PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
CUT = 16
RUN = rf"[+(]?[0-9][0-9().+-]*+(?:\x20[+(]?[0-9][0-9().+-]*+){{0,{CUT - 1}}}+"
LONGEST_SEED = 19  # tokens: a card of 19 digits, each by itself
ROUNDS = 3
SUPPORT = 5  # values that must speak for a pattern
CONFIDENCE = 0.9
BLOCK = 128


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\'") + "'"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """SQL text: does the check sum hold? Every second digit from the right counts double, less 9 above 9."""
    return (f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + cast(substr(if(i % 2 = 1, '0123456789', "
            f"'0246813579'), cast(substr({digits}, -i, 1) as int) + 1, 1) as int)) % 10 = 0")


def valid(kind: str, value: str) -> str:
    """SQL text: does a match pass its kind's test?"""
    if kind == "ip":
        return f"{value} rlike {_quoted(_IP)}"
    if kind == "card":
        return f"length({_digits(value)}) between 16 and 19 and {luhn(_digits(value))}"
    if kind == "phone":
        return f"length({_digits(value)}) between 8 and 15"
    return "true"


def _before(lengths: str, blocks: str) -> str:
    """SQL text: sums of all earlier entries, each from its own block and the sums of earlier blocks."""
    return (f"transform({lengths}, (v, i) -> {blocks}[cast(i div {BLOCK} as int)] + "
            f"aggregate(slice({lengths}, cast(i div {BLOCK} as int) * {BLOCK} + 1, i % {BLOCK}), 0L, (x, y) -> x + y))")


def _block_sums(lengths: str) -> str:
    return (f"transform(sequence(0, cast((size({lengths}) - 1) div {BLOCK} as int)), b -> "
            f"aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), 0L, (x, y) -> x + y))")


def _block_starts(sums: str) -> str:
    return (f"transform(sequence(0, size({sums}) - 1), b -> aggregate(slice({sums}, 1, b), 0L, (x, y) -> x + y))")


def _located(df: DataFrame, patterns: dict[str, str], text: str, where: dict[str, str]) -> DataFrame:
    """Per pattern the columns <name>_hits (matched texts), <name>_gaps (texts between) and <name>_from (code points)."""
    df = with_once(df, {
        **{f"{k}_hits": f"if({where[k]}, regexp_extract_all({text}, {_quoted(p)}, 0), cast(array() as array<string>))"
           for k, p in patterns.items()}})
    df = with_once(df, {
        **{f"{k}_gaps": f"if(size({k}_hits) > 0, split({text}, {_quoted(p)}, -1), cast(array() as array<string>))"
           for k, p in patterns.items()}})
    df = with_once(df, {f"{k}_len": f"transform({k}_hits, (h, i) -> cast(length({k}_gaps[i]) + length(h) as bigint))"
                        for k in patterns})
    none = "cast(array() as array<bigint>)"
    df = with_once(df, {f"{k}_sums": f"if(size({k}_len) > 0, {_block_sums(f'{k}_len')}, {none})" for k in patterns})
    df = with_once(df, {f"{k}_blocks": f"if(size({k}_len) > 0, {_block_starts(f'{k}_sums')}, {none})" for k in patterns})
    df = with_once(df, {f"{k}_from": f"if(size({k}_len) > 0, zip_with({_before(f'{k}_len', f'{k}_blocks')}, "
                                     f"slice({k}_gaps, 1, size({k}_len)), (b, g) -> b + length(g)), {none})"
                        for k in patterns})
    return df.drop(*[f"{k}_{x}" for k in patterns for x in ("len", "sums", "blocks")])


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base``: array of (kind, start, end) by kind, then start; code points, end exclusive. Null text: none."""
    df = with_once(docs.drop("base", "_t"), {"_t": f"coalesce({text}, '')"})
    digit = "_t rlike '[0-9]'"
    df = _located(df, PATTERN, "_t", {
        "email": "contains(_t, '@')", "ip": digit, "card": digit, "phone": r"_t rlike '[+][0-9]'"})
    each = [
        f"transform(filter(zip_with({k}_hits, {k}_from, (h, s) -> named_struct('value', h, 'start', s)), "
        f"x -> {valid(k, 'x.value')}), x -> named_struct('kind', '{k}', 'start', x.start, "
        f"'end', x.start + length(x.value)))" for k in KINDS]
    df = with_once(df, {"base": f"concat({', '.join(each)})"})
    return df.drop("_t", *[f"{k}_{x}" for k in KINDS for x in ("hits", "gaps", "from")])


def spelled(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _word(found: str) -> str:
    """SQL text: a word of a context, small, digits as 9; any address as @."""
    small = f"regexp_replace(lower({found}), '[0-9]+', '9')"
    return f"if({small} like '%@%', '@', {small})"


def _runs(df: DataFrame, text: str) -> DataFrame:
    """Add ``runs``: array of (start, tokens, more, near, left, right, whole).

    ``more`` are tokens after a cut, ``near`` the base spans that any of these meet, ``left`` and ``right`` the words around,
    ``whole`` whether the run is cut at neither end.
    """
    df = with_once(df, {"_t": f"coalesce({text}, '')"})
    df = _located(df, {"run": RUN}, "_t", {"run": "_t rlike '[0-9]'"})
    ahead = f"if(get(run_gaps, i + 1) = ' ', slice(split(get(run_hits, i + 1), ' '), 1, {LONGEST_SEED - 1}), array())"
    left = _word(r"regexp_extract(right(get(run_gaps, i), 60), r'(\S+)\s*$', 1)")
    right = _word(r"regexp_extract(left(get(run_gaps, i + 1), 60), r'^\s*(\S+)', 1)")
    df = with_once(df, {"runs": f"""transform(transform(run_hits, (h, i) -> named_struct(
        'start', get(run_from, i), 'hit', h, 'more', coalesce({ahead}, cast(array() as array<string>)),
        'left', if(i > 0 and get(run_gaps, i) = ' ',
          regexp_replace(substring_index(get(run_hits, i - 1), ' ', -1), '[0-9]', '9'), {left}),
        'right', {right},
        'whole', not (i > 0 and get(run_gaps, i) = ' ') and coalesce(get(run_gaps, i + 1) <> ' ' or i + 1 >= size(run_hits), true))),
      r -> named_struct('start', r.start, 'tokens', split(r.hit, ' '), 'more', r.more,
        'near', filter(base, b -> b.start <= r.start + length(r.hit) + length(array_join(r.more, ' ')) and r.start < b.end),
        'left', r.left, 'right', r.right, 'whole', r.whole))"""})
    return df.drop("_t", "run_hits", "run_gaps", "run_from")


def _longest_seed(found: DataFrame) -> int:
    """Tokens of the longest seed among the runs."""
    tokens = ("transform(runs, r -> coalesce(array_max(transform(r.near, b -> size(split(substring("
              "array_join(concat(r.tokens, r.more), ' '), cast(greatest(b.start - r.start, 0) + 1 as int),"
              " cast(b.end - b.start as int)), ' ')))), 1))")
    most = found.where("size(runs) > 0").agg(F.max(F.expr(f"array_max({tokens})"))).first()[0]
    return min(max(most or 1, 1), LONGEST_SEED)


def _candidates(found: DataFrame, most_tokens: int) -> DataFrame:
    """One row per up to ``most_tokens`` tokens of a run: row, value, start, end, seed kind, clear of seeds, patterns."""
    rows = found.where("size(runs) > 0").select("_row", F.explode("runs").alias("r"))
    rows = rows.select("_row", "r.*").withColumn("own", F.size("tokens")).withColumn("tokens", F.concat("tokens", "more"))
    rows = rows.select("*", F.expr("explode(sequence(0, own - 1))").alias("i"))
    rows = rows.select("*", F.expr(f"explode(sequence(1, least({most_tokens}, size(tokens) - i)))").alias("k"))
    rows = rows.selectExpr(
        "_row", "near", "left", "right", "i", "start + length(array_join(slice(tokens, 1, i), ' ')) + if(i > 0, 1, 0) as start",
        r"regexp_replace(array_join(slice(tokens, i + 1, k), ' '), r'[^0-9)]++$', '') as value",
        "if(i = 0, left, regexp_replace(get(tokens, i - 1), '[0-9]', '9')) as word", "whole and i = 0 and k = own as whole")
    rows = rows.where("length(value) >= 6")
    rows = rows.selectExpr("_row", "near", "value", "word", "right", "whole", "start", "start + length(value) as end",
                           "regexp_replace(value, '[0-9]', '9') as shape")
    return rows.selectExpr(
        "_row", "value", "start", "end",
        "try_element_at(filter(near, b -> b.start = start and b.end = end), 1).kind as seed",
        "not exists(near, b -> b.start < end and start < b.end) as clear",
        "concat(array(concat('shape ', shape), concat('after ', word, ' ', shape)), if(whole and word <> '',"
        " array(concat('left ', word), concat('between ', word, ' ', right)), cast(array() as array<string>)),"
        " if(whole and right <> '', array(concat('right ', right)), cast(array() as array<string>))) as patterns")


def confident_patterns(candidates: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT,
                       confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind, score) of the patterns that the graph of patterns and values ends up trusting."""
    edges = saved(candidates.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy(
        "pattern", "value").agg(*[F.max(F.col("seed").eqNullSafe(k)).alias(k) for k in KINDS]), "pii-edges")
    seeds = edges.groupBy("value").agg(*[F.max(k).alias(k) for k in KINDS])
    scores = seeds.select("value", *[F.col(k).cast("double").alias(k) for k in KINDS])
    fits = {k: F.expr(valid(k, "value")) if k != "email" else F.lit(False) for k in KINDS}
    for turn in range(rounds):
        met = edges.select("pattern", "value").join(scores, "value").groupBy("pattern").agg(
            F.count("*").alias("n"), *[F.sum(k).alias(k) for k in KINDS])
        patterns = saved(met.select("pattern", *[
            F.when(F.col(k) >= support, F.col(k) / (F.col("n") + 1)).otherwise(0.0).alias(k) for k in KINDS]).where(
                " or ".join(f"{k} > 0" for k in KINDS)), "pii-patterns")
        if turn < rounds - 1:
            best = edges.select("pattern", "value").join(patterns, "pattern").groupBy("value").agg(
                *[F.max(k).alias(f"_{k}") for k in KINDS])
            scores = seeds.join(best, "value", "left").select("value", *[
                F.when(F.col(k), 1.0).when(fits[k], F.coalesce(f"_{k}", F.lit(0.0))).otherwise(0.0).alias(k)
                for k in KINDS])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("score")) for k in KINDS]))
    return patterns.select("pattern", each.alias("p")).select("pattern", "p.*").where(F.col("score") >= confidence)


def find(docs: DataFrame, text: str = "text", keep_text: bool = True, rounds: int = ROUNDS,
         support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (kind, start, end) by kind as in KINDS, then start.

    ``spans`` holds ``base`` and what the induced patterns add. A null or empty text has no spans.
    Repeated rows each get theirs. Columns base, spans, runs and _row are replaced; others stay,
    ``text`` unless ``keep_text`` is off. An empty table gives an empty table.
    """
    rows = base_spans(docs.drop("base", "spans", "runs", "_row"), text)
    rows = _runs(rows, text).withColumn("_row", F.monotonically_increasing_id())
    found = saved(rows if keep_text else rows.drop(text), "pii-found")
    candidates = _candidates(found, _longest_seed(found))
    good = confident_patterns(candidates, rounds, support, confidence)
    passes = F.coalesce(*[F.when(F.col("kind") == k, F.expr(valid(k, "value"))) for k in KINDS], F.lit(False))
    hits = candidates.where("clear").select("_row", "value", "start", "end", F.explode("patterns").alias("pattern")).join(
        good, "pattern").where(passes)
    # Of overlapping ones the better, then the longer, then the first stays.
    order = F.array_sort(F.collect_set(F.struct(
        (-F.col("score")).alias("score"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind")))
    added = hits.groupBy("_row").agg(order.alias("all")).selectExpr(
        "_row", "aggregate(all, cast(array() as array<struct<kind:string,start:bigint,end:bigint>>), (kept, x) -> "
                "if(exists(kept, k -> k.start < x.end and x.start < k.end), kept, "
                "array_append(kept, named_struct('kind', x.kind, 'start', x.start, 'end', x.end)))) as _added")
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), {}.kind)"
    whole = "concat(base, _added)"
    return found.drop("runs").join(added, "_row", "left").withColumn("spans", F.expr(
        f"if(_added is null, base, array_sort({whole}, (a, b) -> case "
        f"when {rank.format('a')} <> {rank.format('b')} then cast({rank.format('a')} - {rank.format('b')} as int) "
        "when a.start <> b.start then cast(sign(a.start - b.start) as int) else cast(sign(a.end - b.end) as int) end))")
    ).drop("_row", "_added")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``text`` by its kind in brackets; of overlapping spans the text of all goes, under the first's kind."""
    merged = ("aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))), "
              "cast(array() as array<struct<start:bigint,end:bigint,kind:string>>), (m, s) -> "
              "if(size(m) > 0 and s.start < element_at(m, -1).end, concat(slice(m, 1, size(m) - 1), array(named_struct("
              "'start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end), 'kind', element_at(m, -1).kind))), "
              "array_append(m, s)))")
    df = with_once(found, {"_m": merged})
    parts = ("concat(array_join(transform(_m, (s, i) -> concat(substring({t}, cast(if(i = 0, 0L, _m[i - 1].end) + 1 as int), "
             "cast(s.start - if(i = 0, 0L, _m[i - 1].end) as int)), '[', upper(s.kind), ']')), ''), "
             "substring({t}, cast(element_at(_m, -1).end + 1 as int)))").format(t=text)
    return df.withColumn(text, F.expr(f"if(size(_m) = 0, {text}, {parts})")).drop("_m", "base", "spans")
