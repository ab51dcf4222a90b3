"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import scratch

from .common import documents

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op5_token_files")
def op5_token_files(spark, sf_dir) -> DataFrame:
    from .token_files import read_tokens, write_tokens
    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, tokenizer("byte_bpe_50k.json"), end=2)
    return read_tokens(spark, path)


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir) -> DataFrame:
    from .token_counts import token_counts
    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


@query("op8_best_fit")
def op8_best_fit(spark, sf_dir) -> DataFrame:
    from .packing import pack, token_pieces
    return pack(token_pieces(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end=1, capacity=4096), 4096)


@query("op1_quality")
def op1_quality(spark, sf_dir) -> DataFrame:
    from .quality import quality
    return quality(documents(spark, sf_dir))


@query("op4_secrets")
def op4_secrets(spark, sf_dir) -> DataFrame:
    from .secrets import BASE, build_index, scan
    docs, path = documents(spark, sf_dir), scratch(spark, "trigrams")
    build_index(docs, path)
    found = scan(docs, spark.read.parquet(path))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[number(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir) -> DataFrame:
    from .decontaminate import decontaminate
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op3_jaccard", r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS sh FROM (
  SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 2))) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.c + ny.c - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS id, doc_id AS label FROM documents UNION SELECT b.y, r.label FROM r JOIN b ON b.x = r.id)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_shingles, min(label) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN r ON r.id = doc_id GROUP BY doc_id, c""")
def op3_jaccard(spark, sf_dir) -> DataFrame:
    from .jaccard import jaccard_components
    return jaccard_components(documents(spark, sf_dir))


@query("op6_repeats")
def op6_repeats(spark, sf_dir) -> DataFrame:
    from .repeats import remove_repeats
    found = remove_repeats(documents(spark, sf_dir), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_lines")
def op10_lines(spark, sf_dir) -> DataFrame:
    from .lines import dedup_lines
    return dedup_lines(documents(spark, sf_dir)).drop("row")


@query("op9_maxent")
def op9_maxent(spark, sf_dir) -> DataFrame:
    from .maxent import train_and_score
    return train_and_score(documents(spark, sf_dir))


@query("op11_filter_audit", r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
x AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM m LEFT JOIN g USING (doc_id)),
y AS (SELECT part, good, bad, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END) || (CASE WHEN f.C THEN 'C' ELSE '' END)
  || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed, count(*) AS n FROM x GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS own, failed, n, good, bad, contains(failed, filter_order[step]) AS fails FROM s, y),
q AS (SELECT *, len(translate(left(filter_order, step - 1), failed, '')) < step - 1 AS earlier FROM r),
z AS (SELECT part, filter_order, step, any_value(own) AS own,
  sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN fails AND NOT earlier AND bad THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM q GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z""")
def op11_filter_audit(spark, sf_dir) -> DataFrame:
    from .filter_audit import filter_audit
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op13_source_divergence", r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (n.n + 2 * l.v) AS p,
  1 + 1000000000 * (k.c + 2) // (l.n + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT lang, source, 'pair' AS part, item, coalesce(x.value, 0) AS value
  FROM (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source) LEFT JOIN x USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10""")
def op13_source_divergence(spark, sf_dir) -> DataFrame:
    from .source_divergence import divergence
    return divergence(documents(spark, sf_dir))


@query("op12_simhash")
def op12_simhash(spark, sf_dir) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir))
