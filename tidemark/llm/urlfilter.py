"""URL filter: listed rules first, then a ratio of character language models.

Rules (host, path, verdict) judge what they fit; the longest wins. The URLs that rules
accept and reject, each distinct one once, teach two variable-order Markov models over a
reduced alphabet: a context of up to ``ORDER`` characters is kept if it is at least one
``contexts``-th of all training positions of its order, so the model has at most
``ORDER`` * ``contexts`` + 1 rows however large the corpus, and only grows sharper with it.
Probabilities are smoothed towards the next shorter context by the number of different
successors (Witten-Bell). A URL's score is its log-likelihood difference (rejected minus
accepted) per character; the threshold is calibrated on labelled URLs of a fold that the
models have not seen, at the least sum of both error rates.

Main path in DataFrame functions only. Log ratios are whole numbers (1/10,000), so sums
do not depend on their order. The model is broadcast: its size is bounded by construction.

Edge cases: a URL that is null or has no ``://`` has an empty host and path, fits no rule
and is scored as it is (null: as empty). With no accepted or no rejected URL to learn
from, everything without a rule is allowed. Repeated rows are judged alike, each for
itself; rows need no id. An empty table gives an empty result; other columns are ignored,
whatever their names. URLs of any length are scored whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage

# The filter's rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Symbols of the models: letters, one for all digits, URL marks, any other (*), before the start (^), end ($).
ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%~+*^$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[^a-z0/.\-_?=&#:%~+]"
ORDER = 4
UNIT = 10_000
STEP, REACH = 100, 400  # of calibration: buckets of STEP / UNIT up to REACH of them on either side


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, ``rule`` and the rule's ``verdict``, null where none fits. A short list of rules is one expression."""
    host, path = parts()
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for h, start, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(start))
        rule, verdict = F.when(fits, h + start).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return p.withColumns({"rule": rule, "verdict": verdict})


def reduced(url: str = "url") -> Column:
    """What the models read: the URL behind ``://`` in their alphabet."""
    text = F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit(""))
    return F.regexp_replace(F.translate(text, UPPER + "123456789", LOWER + "0" * 9), OTHER, "*")


def positions(df: DataFrame, text: str) -> DataFrame:
    """A row for every symbol of ``text`` and its end: ``ctx``, the ``ORDER`` symbols before it, and ``sym``, its number from 1."""
    padded = F.concat(F.lit("^" * ORDER), text, F.lit("$"))
    d = df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(text) + 1)))
    return d.withColumns({"ctx": F.substring(padded, F.col("_i"), F.lit(ORDER)), "sym": F.instr(F.lit(ALPHABET), F.substring(padded, F.col("_i") + ORDER, F.lit(1)))}).drop("_i")


def labelled(rows: DataFrame) -> DataFrame:
    """The distinct URLs that rules judge, as ``text``, ``rejected`` and whether they calibrate (``held``)."""
    d = rows.where("verdict is not null").select(reduced().alias("text"), (F.col("verdict") == "block").alias("rejected")).distinct()
    return d.withColumn("held", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 7), 16, 10).cast("int") % 5 == 0)


def train(known: DataFrame, contexts: int = 2000) -> DataFrame | None:
    """(ctx, ratios): for every kept context the log ratio, rejected over accepted, of each symbol of the alphabet."""
    grams = stage(positions(known.where("not held").select("text", "rejected"), "text").groupBy("ctx", "sym").agg(F.count_if("rejected").alias("r"), F.count_if(~F.col("rejected")).alias("a")), "url_grams")
    seen = grams.agg(F.sum("r").alias("r"), F.sum("a").alias("a")).first()
    if not seen["r"] or not seen["a"]:
        return None
    least = -(-(seen["r"] + seen["a"]) // contexts)
    model = None
    for k in range(ORDER + 1):
        each = grams.groupBy(F.right("ctx", F.lit(k)).alias("ctx") if k else F.lit("").alias("ctx"), "sym").agg(F.sum("r").alias("r"), F.sum("a").alias("a"))
        by_sym = F.map_from_entries(F.collect_list(F.struct("sym", F.struct("r", "a"))))  # at most one entry a symbol
        kept = each.groupBy("ctx").agg(by_sym.alias("m"), F.sum(F.col("r") + F.col("a")).alias("n")).where(F.col("n") >= least)
        for side in "ra":
            kept = kept.withColumn(f"n_{side}", _by_symbol("m", side))
        if not k:
            level = kept.select("ctx", *(_smoothed_start(f"n_{s}", seen[s]).alias(f"p_{s}") for s in "ra"))
        else:
            shorter = level.select(F.col("ctx").alias("_short"), F.col("p_r").alias("_r"), F.col("p_a").alias("_a"))
            joined = kept.withColumn("_short", F.right("ctx", F.lit(k - 1)) if k > 1 else F.lit("")).join(F.broadcast(shorter), "_short")
            level = joined.select("ctx", *(_smoothed(f"n_{s}", f"_{s}").alias(f"p_{s}") for s in "ra"))
        level = stage(level, "url_model_order")
        model = level if model is None else model.unionByName(level)
    ratios = F.zip_with("p_r", "p_a", lambda r, a: F.round(F.log(r / a) * UNIT).cast("long"))
    return stage(model.select("ctx", ratios.alias("ratios")), "url_model")


def _by_symbol(entries: str, side: str) -> Column:
    """Counts of every symbol, from a map of symbols to counts of both sides."""
    return F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda i: F.coalesce(F.try_element_at(entries, i)[side], F.lit(0)))


def _smoothed_start(counts: str, total: int) -> Column:
    return F.transform(counts, lambda n: (n + 1) / F.lit(float(total + len(ALPHABET))))


def _smoothed(counts: str, shorter: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)
    kinds = F.greatest(F.size(F.filter(counts, lambda n: n > 0)), F.lit(1))
    return F.zip_with(counts, shorter, lambda n, p: (n + kinds * p) / (total + kinds))


def scored(df: DataFrame, text: str, model: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row with ``bucket``, its log ratio a symbol in steps of the calibration."""
    d = positions(df.select(*keep, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_id")), "_text")
    found = []
    for k in range(ORDER, -1, -1):
        table = F.broadcast(model.where(F.length("ctx") == k).select(F.col("ctx").alias(f"_c{k}"), F.col("ratios").alias(f"_r{k}")))
        d = d.withColumn(f"_c{k}", F.right("ctx", F.lit(k)) if k else F.lit("")).join(table, f"_c{k}", "left")
        found.append(F.get(f"_r{k}", F.col("sym") - 1))
    total = d.groupBy("_id").agg(*(F.first(c).alias(c) for c in keep), F.sum(F.coalesce(*found)).alias("_sum"), F.count("*").alias("_n"))
    bucket = F.floor(F.col("_sum") / (F.col("_n") * STEP))
    return total.select(*keep, F.least(F.greatest(bucket, F.lit(-REACH)), F.lit(REACH)).alias("bucket"))


def threshold(known: DataFrame, model: DataFrame) -> int:
    """The bucket from which on URLs are rejected; 0 if a class has no URL that calibrates."""
    counts = {(r["bucket"], r["rejected"]): r["n"] for r in scored(known.where("held"), "text", model, ["rejected"]).groupBy("bucket", "rejected").agg(F.count("*").alias("n")).collect()}  # at most 4 * REACH + 2
    bad, good = (sum(n for (_, r), n in counts.items() if r == side) for side in (True, False))
    if not bad or not good:
        return 0

    def errors(t: int) -> int:
        missed = sum(n for (b, r), n in counts.items() if r and b < t)
        wronged = sum(n for (b, r), n in counts.items() if not r and b >= t)
        return missed * good + wronged * bad

    return min(range(-REACH, REACH + 2), key=lambda t: (errors(t), abs(t), t))


def classify(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, contexts: int = 2000) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    rows = judged(pages, rules)
    known = stage(labelled(rows), "url_labels")
    model = train(known, contexts)
    own = ["page_id", "host", "path", "rule"]
    rest = rows.where("verdict is null")
    if model is None:
        rest = rest.select(*own, F.lit("allow").alias("verdict"))
    else:
        limit = threshold(known, model)
        rest = scored(rest.withColumn("_reduced", reduced()), "_reduced", model, own).select(*own, F.when(F.col("bucket") >= limit, "block").otherwise("allow").alias("verdict"))
    return rows.where("verdict is not null").select(*own, "verdict").unionByName(rest)


def oracle_sql(rules: tuple[tuple[str, str, str], ...] = RULES, contexts: int = 2000) -> str:
    """The same filter in DuckDB over ``pages``."""
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN '{c[i]}'" for c in cases) + " END"
    size = len(ALPHABET)
    orders = []
    for k in range(ORDER + 1):
        short = f"right(s.ctx, {k - 1})" if k > 1 else "''"
        start = f"SELECT ctx, sym, (r + 1) / (sum(r) OVER () + {size}.0) AS pr, (a + 1) / (sum(a) OVER () + {size}.0) AS pa FROM c0"
        mixed = f"""SELECT s.ctx, s.sym, (s.r + s.kr * p.pr) / (s.tr + s.kr) AS pr, (s.a + s.ka * p.pa) / (s.ta + s.ka) AS pa
            FROM (SELECT *, sum(r) OVER w AS tr, sum(a) OVER w AS ta, greatest(count(*) FILTER (r > 0) OVER w, 1) AS kr, greatest(count(*) FILTER (a > 0) OVER w, 1) AS ka FROM c{k} WINDOW w AS (PARTITION BY ctx)) s
            JOIN m{k - 1} p ON p.ctx = {short} AND p.sym = s.sym"""
        ctx = f"right(ctx, {k})" if k else "''"
        orders.append(f"""g{k} AS (SELECT {ctx} AS ctx, sym, sum(r) AS r, sum(a) AS a FROM grams GROUP BY ALL),
        k{k} AS (SELECT ctx FROM g{k} GROUP BY ctx HAVING sum(r + a) >= (SELECT ceil(sum(r + a) / {contexts}.0) FROM grams)),
        c{k} AS MATERIALIZED (SELECT k.ctx, i.sym, coalesce(g.r, 0) AS r, coalesce(g.a, 0) AS a FROM k{k} k CROSS JOIN (SELECT unnest(range(1, {size + 1})) AS sym) i LEFT JOIN g{k} g ON g.ctx = k.ctx AND g.sym = i.sym),
        m{k} AS MATERIALIZED ({mixed if k else start})""")
    best = ", ".join(f"m{k}.q" for k in range(ORDER, -1, -1))
    joins = " ".join(f"LEFT JOIN model m{k} ON m{k}.ctx = {f'right(s.ctx, {k})' if k else chr(39) * 2} AND m{k}.sym = s.sym" for k in range(ORDER, -1, -1))
    spread = lambda src, keep: f"SELECT {keep}, substr('{'^' * ORDER}' || text || '$', i, {ORDER}) AS ctx, instr('{ALPHABET}', substr('{'^' * ORDER}' || text || '$', i + {ORDER}, 1)) AS sym FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM {src})"
    return rf"""
        WITH rest AS (SELECT page_id, url, row_number() OVER () AS id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS t FROM pages),
        cut AS (SELECT page_id, url, id, coalesce(translate(regexp_extract(t, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(t, '^[^/?#]*([^?#]*)', 1), '') AS path,
                       regexp_replace(translate(coalesce(t, url, ''), '{UPPER}123456789', '{LOWER}{'0' * 9}'), '{OTHER}', '*', 'g') AS text FROM rest),
        judged AS (SELECT *, {case(1)} AS rule, {case(2)} AS verdict FROM cut),
        known AS (SELECT DISTINCT text, verdict = 'block' AS rejected FROM judged WHERE verdict IS NOT NULL),
        folds AS MATERIALIZED (SELECT *, row_number() OVER () AS id, ('0x' || substr(md5(text), 1, 7))::BIGINT % 5 = 0 AS held FROM known),
        grams AS MATERIALIZED (SELECT ctx, sym, count(*) FILTER (rejected) AS r, count(*) FILTER (NOT rejected) AS a FROM ({spread("folds", "held, rejected")}) WHERE NOT held GROUP BY ALL),
        {", ".join(orders)},
        model AS MATERIALIZED ({" UNION ALL ".join(f"SELECT ctx, sym, round(ln(pr / pa) * {UNIT})::BIGINT AS q FROM m{k}" for k in range(ORDER + 1))}),
        spread AS ({spread("folds", "true AS calibrates, id, rejected, held")} WHERE held UNION ALL {spread("judged", "false AS calibrates, id, NULL AS rejected, NULL AS held")} WHERE verdict IS NULL),
        scored AS MATERIALIZED (SELECT calibrates, id, any_value(rejected) AS rejected, least(greatest(floor(sum(coalesce({best})) / (count(*) * {STEP})), -{REACH}), {REACH}) AS bucket
                   FROM spread s {joins} GROUP BY calibrates, id),
        sides AS (SELECT count(*) FILTER (rejected) AS bad, count(*) FILTER (NOT rejected) AS good FROM scored WHERE calibrates),
        errors AS (SELECT t, count(*) FILTER (rejected AND bucket < t) * any_value(good) + count(*) FILTER (NOT rejected AND bucket >= t) * any_value(bad) AS e
                   FROM scored, sides, (SELECT unnest(range(-{REACH}, {REACH + 2})) AS t) WHERE calibrates AND good > 0 AND bad > 0 GROUP BY t),
        lim AS (SELECT coalesce((SELECT t FROM errors ORDER BY e, abs(t), t LIMIT 1), 0) AS t)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN (SELECT min(r) > 0 AND min(a) > 0 FROM (SELECT sum(r) AS r, sum(a) AS a FROM grams)) AND s.bucket >= (SELECT t FROM lim) THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged j LEFT JOIN scored s ON NOT s.calibrates AND s.id = j.id
    """
