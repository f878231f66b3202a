"""Content resources on the given tables: documents serve as resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators import content as C
from tabloom.plans.bindings import table, with_clause
from tabloom.plans.catalog import query
from tabloom.plans.sqltext import q
from tabloom.schema import LIST_FIELDS
from tabloom.session import scratch_path
from tabloom.sources import readers, sinks

TODAY, BASE_URL = "2024-03-01", "https://example.org"


def resources(spark, sf, name="res"):
    """A flat binding with its nested columns put together."""
    df = table(spark, sf, name)
    score = (F.col("doc_id") % 110).cast("double")
    return df.withColumns({
        "hero": F.struct(
            F.col("title").alias("headline"), F.col("summary").alias("subheadline"),
            F.when(F.col("doc_id") % 11 == 0, "").otherwise("Go").alias("primaryCta"),
        ),
        "faq": F.arrays_zip(F.col("faq_q").alias("question"), F.col("faq_a").alias("answer")),
        "relatedProductLinks": F.transform("relatedProductLinks", lambda x: F.struct(x.alias("label"), F.lit("/").alias("url"))),
        "sections": F.transform("sec_b", lambda b: F.struct(F.lit("Part").alias("heading"), b.alias("body"))),
        "qualityReview": F.struct(
            score.alias("intentMatchScore"), F.lit(90.0).alias("uniquenessScore"),
            F.when(F.col("doc_id") % 19 != 0, 10.0).alias("thinContentRisk"), F.lit(5.0).alias("duplicationRisk"),
            F.lit(95.0).alias("productTruthfulnessScore"), F.lit(95.0).alias("helpfulnessScore"),
            F.when(F.col("doc_id") % 23 == 0, "maybe").otherwise("index").alias("indexRecommendation"),
        ),
    }).drop("faq_q", "faq_a", "sec_b")


def s_missing(names) -> str:
    nulls = {"hero", "qualityReview", "faq"}
    col = {"sections": "sec_b"}
    return "list_filter([" + ", ".join(
        f"CASE WHEN {col.get(n, n)} IS NULL THEN 'Missing required field: {n}' END" for n in names if n not in nulls
    ) + "], lambda e: e IS NOT NULL)"


def s_validate(of: str = "res") -> str:
    c = []
    for name, low, high in C.TEXT_BOUNDS:
        size = f"length(coalesce({name}, ''))"
        c.append(f"CASE WHEN {size} < {low} THEN '{name} too short (min {low}, got ' || {size} || ')' END")
        c.append(f"CASE WHEN {size} > {high} THEN '{name} too long (max {high}, got ' || {size} || ')' END")
    for name, allowed in (("searchIntent", C.INTENTS), ("templateType", C.TEMPLATES), ("indexationStatus", C.STATUSES)):
        c.append(f"CASE WHEN {name} NOT IN ({', '.join(map(q, allowed))}) THEN 'Invalid {name}: ' || {name} END")
    for name in (*LIST_FIELDS[:9], *LIST_FIELDS[9:]):
        c.append(f"CASE WHEN {name} IS NULL THEN '{name} must be an array' END")
    c.append("CASE WHEN title = '' THEN 'hero.headline is required' END")
    c.append("CASE WHEN doc_id % 11 = 0 THEN 'hero.primaryCta is required' END")
    c.append("CASE WHEN doc_id % 110 > 100 THEN 'qualityReview.intentMatchScore must be 0-100' END")
    c.append("CASE WHEN doc_id % 19 = 0 THEN 'qualityReview.thinContentRisk must be a number' END")
    c.append("CASE WHEN doc_id % 23 = 0 THEN 'qualityReview.indexRecommendation invalid' END")
    c.append("CASE WHEN slug <> '' AND NOT regexp_matches(slug, '^[a-z0-9][a-z0-9-]*[a-z0-9]$') THEN 'slug must be lowercase alphanumeric with hyphens, not starting/ending with hyphen' END")
    faq = "list_transform(faq_a, lambda a, i: CASE WHEN coalesce(a, '') = '' OR coalesce(faq_q[i], '') = '' THEN 'faq[' || (i - 1) || '] missing question or answer' END)"
    sec = ("coalesce(list_transform(sec_b, lambda b, i: CASE WHEN coalesce(b, '') = '' THEN 'sections[' || (i - 1) || '] missing heading or body' "
           "WHEN length(b) < 100 THEN 'sections[' || (i - 1) || '] body too short (min 100 chars, got ' || length(b) || ')' END), [])")
    return f"""{with_clause(of)}, m AS (SELECT *, CASE WHEN templateType IN ('guide', 'industry_insight') THEN {s_missing(C.REQUIRED_EDITORIAL)} ELSE {s_missing(C.REQUIRED)} END AS absent FROM {of})
    SELECT slug, array_to_string(CASE WHEN len(absent) > 0 THEN absent ELSE list_filter([{', '.join(c)}] || {faq} || {sec}, lambda e: e IS NOT NULL) END, '; ') AS errors FROM m"""


@query("validate_resources", s_validate())
def _(spark, sf):
    return C.validate_resources(resources(spark, sf)).select("slug", F.array_join("errors", "; ").alias("errors"))


def s_rule(i: int) -> str:
    return "CASE templateType " + " ".join(f"WHEN '{t}' THEN {r[i]}" for t, r in C.TEMPLATE_RULES.items()) + f" ELSE {C.DEFAULT_RULE[i]} END"


def s_len(c: str) -> str:
    c = {"faq": "faq_a", "sections": "sec_b"}.get(c, c)
    return f"coalesce(len({c}), 0)"


def s_pts(test: str, points: int) -> str:
    return f"CASE WHEN {test} THEN {points} ELSE 0 END"


def s_scores(of: str = "res") -> str:
    kw = "lower(coalesce(primaryKeyword, ''))"
    words = f"list_filter(regexp_extract_all({kw}, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(map(q, X.KEYWORD_STOP_WORDS))}))"

    def present(c):
        seen = f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
        return (
            f"(len(list_filter({words}, lambda w: list_contains({seen}, w) OR list_contains({seen}, w || 's') OR list_contains({seen}, rtrim(w, 's')))) * 10 >= len({words}) * 8)"
        )

    off = " OR ".join(f"(searchIntent = '{i}' AND templateType NOT IN ({', '.join(map(q, ts))}))" for i, ts in C.EXPECTED_TEMPLATES.items())
    intent = " + ".join([s_pts(f"{kw} <> '' AND NOT {present(c)}", p) for c, p in (("title", -15), ("h1", -10), ("summary", -10), ("metaDescription", -10))] + [s_pts(off, -5)])
    shorts = "len(list_filter(faq_a, lambda a: length(a) < 50))"
    low = "lower(coalesce(summary, ''))"
    uniq = " + ".join(
        [s_pts(f"{shorts} * 2 > len(faq_a)", -20)] + [s_pts(f"contains({low}, {q(p)})", -10) for p in C.FILLERS]
        + [s_pts(f"coalesce(list_sum(list_transform({c}, lambda x: length(x))) / len({c}) < 30, false)", -10) for c in ("whyItFits", "commonChallenges", "howItWorksSteps")]
    )
    chars = "coalesce(list_sum(list_transform(sec_b, lambda b: length(b))), 0)"
    items = " + ".join(s_len(c) for c in ("whoItsFor", "whenThisIsRelevant", "supportedInputs", "expectedOutputs", "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "faq", "exampleUseCases"))
    needed = sorted({f for r in C.TEMPLATE_RULES.values() for f in r[5]})
    thin = " + ".join(
        [s_pts(f"{s_len(c)} < {s_rule(i)}", p) for i, (c, p) in enumerate((("faq", 15), ("howItWorksSteps", 15), ("commonChallenges", 10), ("limitations", 15)))]
        + [s_pts(f"templateType IN ({', '.join(q(t) for t, r in C.TEMPLATE_RULES.items() if f in r[5])}) AND {s_len(f)} = 0", 10) for f in needed]
        + [s_pts("length(coalesce(summary, '')) < 100", 15), s_pts(f"{s_len('sections')} > 0 AND {s_len('sections')} < {s_rule(4)}", 15),
           s_pts(f"{s_len('sections')} > 0 AND {chars} < 600", 15), s_pts(f"{s_len('sections')} = 0 AND {items} < 15", 15)]
    )
    lists = ("whoItsFor", "whenThisIsRelevant", "supportedInputs", "expectedOutputs", "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "exampleUseCases", "trustSignals")
    text = ("lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(h1, ''), coalesce(metaDescription, ''), "
            + ", ".join(f"coalesce(array_to_string({c}, ' '), '')" for c in lists)
            + ", array_to_string(list_transform(faq_a, lambda a, i: faq_q[i] || ' ' || a), ' '), coalesce(array_to_string(list_transform(sec_b, lambda b: 'Part ' || b), ' '), '')))")
    truth = " + ".join([s_pts(f"contains(txt, {q(p)})", w) for ps, w in ((C.DISALLOWED, -20), (C.EXAGGERATIONS, -15), (C.FAKE_PROOF, -10)) for p in ps] + [s_pts(f"{s_len('limitations')} < 1", -15)])
    ed = "templateType IN ('guide', 'industry_insight')"
    depth = f"({chars} / nullif({s_len('sections')}, 0))"
    reps = f"CASE WHEN {kw} <> '' THEN (length({low}) - length(replace({low}, {kw}, ''))) // length({kw}) ELSE 0 END"
    help_ = " + ".join([
        s_pts(f"{s_len('faq')} >= 4", 8), s_pts(f"{s_len('faq')} > 0 AND {shorts} = 0", 5), s_pts(f"{ed} AND {s_len('sections')} >= 4", 10), s_pts(f"{ed} AND {s_len('sections')} = 3", 6),
        s_pts(f"{ed} AND coalesce({depth} >= 300, false)", 10), s_pts(f"{ed} AND coalesce({depth} >= 150 AND {depth} < 300, false)", 5), s_pts(f"{s_len('whoItsFor')} >= 2", 5),
        s_pts(f"NOT {ed} AND {s_len('howItWorksSteps')} >= 3", 8), s_pts(f"NOT {ed} AND {s_len('limitations')} >= 2", 8), s_pts(f"NOT {ed} AND {s_len('exampleUseCases')} >= 2", 5),
        s_pts(f"NOT {ed} AND {s_len('trustSignals')} >= 2", 3), s_pts(f"{s_len('relatedResources')} >= 1", 3), s_pts(f"{reps} > 4", -15)])
    b = lambda e: f"CAST(least(100, greatest(0, {e})) AS INTEGER)"
    return f"""{with_clause(of)}, t AS (SELECT *, {text} AS txt FROM {of}) SELECT slug, {b('100 + ' + intent)} AS intent, {b('100 + ' + uniq)} AS uniqueness, {b(thin)} AS thin,
      {b('100 + ' + truth)} AS truthfulness, {b('60 + ' + help_)} AS helpfulness FROM t"""


@query("resource_scores", s_scores())
def _(spark, sf):
    return C.resource_scores(resources(spark, sf)).select("slug", "intent", "uniqueness", "thin", "truthfulness", "helpfulness")


def s_wc(e: str) -> str:
    return rf"len(list_filter(string_split_regex(coalesce({e}, ''), '\s+'), lambda w: w <> ''))"


S_READ = " + ".join([s_wc("summary")] + [f"coalesce(CAST(list_sum(list_transform({c}, lambda x: {s_wc('x')})) AS BIGINT), 0)" for c in ("sec_b", "faq_a", "whoItsFor", "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "exampleUseCases")])


@query("read_time", f"{with_clause('res')} SELECT slug, CAST({S_READ} AS INTEGER) AS words, CAST(greatest(1, round_even(({S_READ}) / 230.0::DOUBLE, 0)) AS INTEGER) AS minutes FROM res")
def _(spark, sf):
    return C.read_time(resources(spark, sf))


S_CW = f"list_filter(regexp_extract_all(lower(coalesce({{c}}, '')), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(map(q, X.STOP_WORDS))}))"


def s_jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


S_RISK = f"""words AS MATERIALIZED (SELECT slug, templateType AS tt, lower(primaryKeyword) AS kw, {S_CW.format(c='primaryKeyword')} AS kl, list_distinct({S_CW.format(c='primaryKeyword')}) AS k,
      list_distinct({S_CW.format(c='title')}) AS t, list_distinct({S_CW.format(c='summary')}) AS s FROM res),
    sims AS MATERIALIZED (SELECT a.slug, a.kw = b.kw AND a.kw <> '' AS same, a.tt = b.tt AS st, {s_jac('a.k', 'b.k')} AS kj, {s_jac('a.t', 'b.t')} AS tj, {s_jac('a.s', 'b.s')} AS sj,
      len(a.kl) = len(b.kl) AND len(a.k) - len(list_intersect(a.k, b.k)) = 1 AND len(b.k) - len(list_intersect(a.k, b.k)) = 1 AND len(list_intersect(a.k, b.k)) >= 3 AS swap
      FROM words a JOIN words b ON a.slug <> b.slug),
    risk AS MATERIALIZED (SELECT slug, max(greatest(CASE WHEN same THEN 90 WHEN kj > 0.85 THEN CASE WHEN st THEN 70 ELSE 60 END WHEN kj > 0.7 THEN CASE WHEN st THEN 45 ELSE 30 END ELSE 0 END,
      CASE WHEN tj > 0.8 THEN 60 ELSE 0 END, CASE WHEN sj > 0.75 THEN 50 ELSE 0 END, CASE WHEN swap THEN CASE WHEN st THEN 60 ELSE 35 END ELSE 0 END)) AS duplication,
      concat_ws(',', CASE WHEN bool_or(same) THEN 'keyword_exact' END, CASE WHEN bool_or(NOT same AND kj > 0.7 AND kj <= 0.85) THEN 'keyword_moderate' END,
        CASE WHEN bool_or(swap) THEN 'keyword_swap' END, CASE WHEN bool_or(NOT same AND kj > 0.85) THEN 'keyword_very_high' END,
        CASE WHEN bool_or(sj > 0.75) THEN 'summary' END, CASE WHEN bool_or(tj > 0.8) THEN 'title' END) AS signals FROM sims GROUP BY slug)"""


@query("duplicate_risk", f"{with_clause('res')}, {S_RISK} SELECT slug, duplication, signals FROM risk")
def _(spark, sf):
    df = table(spark, sf, "res").select("slug", "templateType", "primaryKeyword", "title", "summary")
    return C.duplicate_risk(df, df).withColumn("signals", F.array_join("signals", ","))


S_PAIR = """greatest(CASE WHEN same THEN 90 WHEN kj > 0.85 THEN CASE WHEN st THEN 70 ELSE 60 END WHEN kj > 0.7 THEN CASE WHEN st THEN 45 ELSE 30 END ELSE 0 END,
      CASE WHEN tj > 0.8 THEN 60 ELSE 0 END, CASE WHEN sj > 0.75 THEN 50 ELSE 0 END, CASE WHEN swap THEN CASE WHEN st THEN 60 ELSE 35 END ELSE 0 END)"""
S_STRICT = " AND ".join(f"{k} {'<=' if k in ('thin', 'duplication') else '>='} {v}" for k, v in C.GATES.items())
S_LOOSE = " AND ".join(f"{k} {'<=' if k == 'duplication' else '>='} {v}" for k, v in C.LENIENT.items())


def s_publish() -> str:
    """Candidates one by one: each is compared with what is published and with those accepted before it."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT * FROM ({s_validate('pub')})), sc AS MATERIALIZED (SELECT * FROM ({s_scores('pub')})),
    everyone AS MATERIALIZED (SELECT * FROM ({with_clause('pub')} SELECT doc_id, slug, templateType, primaryKeyword, title, summary, indexationStatus = 'published' AS known FROM pub)),
    words AS MATERIALIZED (SELECT doc_id, slug, known, templateType AS tt, lower(primaryKeyword) AS kw, {S_CW.format(c='primaryKeyword')} AS kl, list_distinct({S_CW.format(c='primaryKeyword')}) AS k,
      list_distinct({S_CW.format(c='title')}) AS t, list_distinct({S_CW.format(c='summary')}) AS s FROM everyone),
    sims AS MATERIALIZED (SELECT a.doc_id, b.doc_id AS other, b.known, a.kw = b.kw AND a.kw <> '' AS same, a.tt = b.tt AS st, {s_jac('a.k', 'b.k')} AS kj, {s_jac('a.t', 'b.t')} AS tj, {s_jac('a.s', 'b.s')} AS sj,
      len(a.kl) = len(b.kl) AND len(a.k) - len(list_intersect(a.k, b.k)) = 1 AND len(b.k) - len(list_intersect(a.k, b.k)) = 1 AND len(list_intersect(a.k, b.k)) >= 3 AS swap
      FROM words a JOIN words b ON a.slug <> b.slug WHERE NOT a.known),
    pairs AS (SELECT doc_id, other, known, {S_PAIR} AS r FROM sims),
    risks AS (SELECT doc_id, coalesce(max(r) FILTER (known), 0) AS base, coalesce(list({{'o': other, 'r': r}}) FILTER (NOT known AND r > 0), []) AS near FROM pairs GROUP BY doc_id),
    n AS MATERIALIZED (SELECT e.doc_id, e.slug, v.errors = '' AS valid, intent, uniqueness, thin, truthfulness, helpfulness, base, near, row_number() OVER (ORDER BY e.doc_id) AS pos
      FROM everyone e JOIN v ON v.slug = e.slug JOIN sc ON sc.slug = e.slug JOIN risks k ON k.doc_id = e.doc_id WHERE NOT known),
    walk AS (SELECT CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS taken, 0 AS indexed, CAST(NULL AS BIGINT) AS doc_id, '' AS slug, 0 AS duplication, '' AS decision
      UNION ALL SELECT pos, CASE WHEN decision IN ('published', 'noindex') THEN list_append(taken, doc_id) ELSE taken END, CASE WHEN decision = 'published' THEN indexed + 1 ELSE indexed END, doc_id, slug, duplication, decision
      FROM (SELECT *, CASE WHEN NOT valid THEN 'rejected' WHEN len(taken) >= {C.PUBLISH_QUOTA} THEN 'draft' WHEN {S_STRICT} AND indexed < {C.INDEX_QUOTA} THEN 'published'
          WHEN {S_LOOSE} THEN 'noindex' WHEN NOT ({S_STRICT}) THEN 'rejected' ELSE 'draft' END AS decision
        FROM (SELECT n.*, w.taken, w.indexed, greatest(n.base, coalesce(list_max(list_transform(list_filter(n.near, lambda x: list_contains(w.taken, x.o)), lambda x: x.r)), 0)) AS duplication
          FROM walk w JOIN n ON n.pos = w.pos + 1) a) b)
    SELECT doc_id, slug, CAST(duplication AS INTEGER) AS duplication, decision FROM walk WHERE pos > 0"""


@query("publish_decisions", s_publish())
def _(spark, sf):
    df = resources(spark, sf, "pub")
    known = F.col("indexationStatus") == "published"
    return C.publish_decisions(df.filter(~known), df.filter(known), "doc_id")


@query(
    "search_resources",
    f"{with_clause('res')} SELECT slug FROM res WHERE indexationStatus IN ('published', 'noindex') AND (contains(lower(title), 'the') OR contains(lower(coalesce(metaDescription, '')), 'the') OR contains(lower(primaryKeyword), 'the'))",
)
def _(spark, sf):
    return C.search_resources(table(spark, sf, "res"), "The").select("slug")


@query("recent", f"{with_clause('res')} SELECT slug, publishedAt FROM res WHERE indexationStatus IN ('published', 'noindex') ORDER BY publishedAt DESC, slug LIMIT 6")
def _(spark, sf):
    return C.recent(C.search_resources(table(spark, sf, "res"), "")).select("slug", "publishedAt")


@query("listed_by_type", f"{with_clause('res')} SELECT templateType, count(*) AS resources FROM res WHERE indexationStatus IN ('published', 'noindex') GROUP BY 1")
def _(spark, sf):
    return C.listed_by_type(C.search_resources(table(spark, sf, "res"), ""))


@query("all_slugs", f"{with_clause('res')} SELECT DISTINCT 'doc-' || (doc_id % 300) AS slug FROM res WHERE indexationStatus <> 'noindex'")
def _(spark, sf):
    df = table(spark, sf, "res").withColumn("slug", F.concat(F.lit("doc-"), (F.col("doc_id") % 300).cast("string")))
    return C.all_slugs(*[df.filter(F.col("indexationStatus") == s) for s in ("published", "draft", "rejected")])


TOPICS = """SELECT p_partkey, 'topic-' || CAST(p_partkey AS STRING) AS slug, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'file_conversion' WHEN 1 THEN 'guide' WHEN 2 THEN 'workflow' ELSE 'document_type' END AS template,
  CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN 'transactional' WHEN 1 THEN 'informational' ELSE 'commercial' END AS intent, p_brand AS cluster, p_size % 10 AS priority FROM {part}"""
S_TOPICS = TOPICS.replace("{part}", "part")
COVERED = "SELECT 'topic-' || CAST(s_suppkey * 3 AS STRING) AS slug FROM {supplier}"
S_COVERED = COVERED.replace("{supplier}", "supplier")


def _topics(spark, sf):
    return spark.sql(TOPICS, part=table(spark, sf, "part")), spark.sql(COVERED, supplier=table(spark, sf, "supplier"))


@query("uncovered", f"WITH t AS ({S_TOPICS}), c AS ({S_COVERED}) SELECT slug, cluster FROM t WHERE slug NOT IN (SELECT slug FROM c)")
def _(spark, sf):
    return C.uncovered(*_topics(spark, sf)).select("slug", "cluster")


@query(
    "rank_topics",
    f"""WITH t AS ({S_TOPICS}), c AS ({S_COVERED}), n AS (SELECT cluster, count(*) AS n FROM t JOIN c USING (slug) GROUP BY 1)
    SELECT slug, priority, CAST(priority * 10 + CASE WHEN template IN ('file_conversion', 'document_type') THEN 10 WHEN template = 'guide' THEN 8 ELSE 0 END
      + CASE intent WHEN 'transactional' THEN 5 WHEN 'informational' THEN 3 ELSE 0 END - CASE WHEN coalesce(n, 0) >= 5 THEN 15 WHEN coalesce(n, 0) >= 3 THEN 5 ELSE 0 END AS INTEGER) AS opportunity
    FROM t LEFT JOIN n USING (cluster) WHERE slug NOT IN (SELECT slug FROM c) ORDER BY opportunity DESC, priority DESC, slug LIMIT 50""",
)
def _(spark, sf):
    topics, covered = _topics(spark, sf)
    return C.rank_topics(topics, covered, 50).select("slug", "priority", "opportunity")


@query(
    "retry_drafts",
    f"""WITH t AS ({S_TOPICS}), n AS (SELECT slug, priority FROM t WHERE p_partkey % 3 = 0), d AS (SELECT slug, priority + 100 AS priority FROM t WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0)
    SELECT * FROM n UNION ALL SELECT * FROM d WHERE slug NOT IN (SELECT slug FROM n)""",
)
def _(spark, sf):
    topics, _ = _topics(spark, sf)
    new = topics.filter("p_partkey % 3 = 0").select("slug", "priority")
    return C.retry_drafts(new, topics.filter("p_partkey % 3 <> 0 or p_partkey % 2 = 0").select("slug", (F.col("priority") + 100).alias("priority")))


@query(
    "related_items",
    f"""{with_clause('res')}, c AS MATERIALIZED (SELECT slug, templateType, doc_id AS ord FROM res), types AS (SELECT templateType, min(ord) AS type_ord FROM c GROUP BY 1),
    cand AS (SELECT slug, templateType FROM res),
    l AS (SELECT cand.slug, CASE WHEN c.templateType = cand.templateType THEN -1 ELSE type_ord END AS tier, c.slug AS other, row_number() OVER (PARTITION BY cand.slug, c.templateType ORDER BY ord) AS r,
      c.templateType = cand.templateType AS own FROM cand JOIN c ON c.slug <> cand.slug JOIN types ON types.templateType = c.templateType QUALIFY (own AND r <= 2) OR r = 1)
    SELECT slug, array_to_string(list_slice(list(other ORDER BY tier, r), 1, 4), ',') AS related FROM l GROUP BY slug""",
)
def _(spark, sf):
    df = table(spark, sf, "res")
    corpus = df.select("slug", "templateType", F.col("doc_id").alias("ord"))
    out = C.related_items(df, corpus)
    return out.withColumn("related", F.array_join("related", ","))


# --- files of resources and run logs ---------------------------------------------------------------------------------

@query(
    "write_registry",
    f"""{with_clause('res')} SELECT slug, title, coalesce(metaDescription, '') AS metaDescription, templateType, primaryKeyword, indexationStatus, publishedAt, templateType AS category
    FROM res WHERE indexationStatus IN ('published', 'noindex')""",
)
def _(spark, sf):
    path = scratch_path(spark, "registry")
    sinks.write_registry(table(spark, sf, "res"), path, TODAY)
    columns = ("slug", "title", "metaDescription", "templateType", "primaryKeyword", "indexationStatus", "publishedAt", "category")
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).json(f"{path}/resources").fillna("", ["metaDescription"])


@query(
    "registry_summary",
    f"{with_clause('res')} SELECT '{TODAY}' AS lastUpdated, count(*) AS totalPublished FROM res WHERE indexationStatus IN ('published', 'noindex')",
)
def _(spark, sf):
    return sinks.registry_summary(table(spark, sf, "res"), TODAY)


@query(
    "write_sitemap",
    f"""{with_clause('res')} SELECT '{BASE_URL}/resources' AS loc, '{TODAY}' AS lastmod, 'weekly' AS changefreq, '0.7' AS priority
    UNION ALL SELECT '{BASE_URL}/resources/' || slug, left(coalesce(updatedAt, publishedAt), 10), 'monthly', '0.6' FROM res WHERE indexationStatus = 'published'""",
)
def _(spark, sf):
    path, df = scratch_path(spark, "sitemap"), table(spark, sf, "res")
    sinks.write_sitemap(df, path, BASE_URL, TODAY)
    blocks = spark.read.text(path, lineSep="</url>\n")
    def part(tag):
        return F.regexp_extract("value", f"<{tag}>([^<]*)<", 1).alias(tag)
    return blocks.select(part("loc"), part("lastmod"), part("changefreq"), part("priority")).filter("loc != ''")


@query(
    "read_resources",
    f"{with_clause('res')} SELECT slug, title, len(howItWorksSteps) AS steps, len(faq_a) AS questions, coalesce(sec_b[1], '') AS first_body FROM res",
)
def _(spark, sf):
    path = scratch_path(spark, "resources")
    df = resources(spark, sf)
    df.write.json(path)
    # unreadable documents beside the good ones
    df.select(F.concat(F.lit('{"slug": "broken-'), F.col("slug").cast("string")).alias("value")).write.mode("append").text(path)
    out = readers.read_resources(spark, path, multi_line=False)
    return out.select(
        "slug", "title", F.size("howItWorksSteps").cast("bigint").alias("steps"), F.size("faq").cast("bigint").alias("questions"),
        F.coalesce(F.get("sections", F.lit(0))["body"], F.lit("")).alias("first_body"),
    )


RUNS = """SELECT 'run_' || CAST(user_id AS STRING) AS run_id, event_type, CAST(event_id AS STRING) AS slug, event_id, ts FROM {events}"""
OUTCOME_OF = {"purchase": "published_index", "signup": "published_noindex", "view": "drafted", "click": "rejected"}


def _run_logs(spark, sf):
    path = scratch_path(spark, "runs")
    runs = spark.sql(RUNS, events=table(spark, sf, "events"))
    def listed(kind):
        return F.collect_list(F.when(F.col("event_type") == kind, F.struct("slug")))
    logs = runs.groupBy("run_id").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("started"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("completed"),
        F.count("*").cast("int").alias("discovered"), F.sum((F.col("event_id") % 2).cast("int")).cast("int").alias("generated"),
        F.collect_list(F.when(F.col("event_type") == "error", F.col("slug"))).alias("generation_failures"),
        F.struct(*[listed(k).alias(o) for k, o in OUTCOME_OF.items()]).alias("publish_results"),
    )
    logs.write.json(path)
    return readers.read_run_logs(spark, path, multi_line=False)


S_RUNS = f"runs AS ({RUNS.replace('{events}', 'events')})"


@query(
    "read_run_logs",
    f"""WITH {S_RUNS}, n AS (SELECT run_id, CAST(count(*) AS INTEGER) AS discovered FROM runs GROUP BY 1) SELECT run_id, discovered,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{o}'" for k, o in OUTCOME_OF.items())} END AS outcome, slug FROM runs JOIN n USING (run_id) WHERE event_type <> 'error'""",
)
def _(spark, sf):
    return _run_logs(spark, sf).select("run_id", "discovered", "outcome", "slug")


S_ROLL = f"""{S_RUNS}, roll AS (SELECT run_id, strftime(min(ts), '%Y-%m-%d') AS run_date, CAST(count(*) AS INTEGER) AS discovered, CAST(sum(event_id % 2) AS INTEGER) AS generated,
      CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS failures, {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {o}" for k, o in OUTCOME_OF.items())},
      CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM runs GROUP BY 1)"""


@query("run_log_rollup", f"WITH {S_ROLL} SELECT * FROM roll")
def _(spark, sf):
    return C.run_log_rollup(_run_logs(spark, sf))


@query(
    "run_log_by_day",
    f"""WITH {S_ROLL} SELECT run_date, count(*) AS runs, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('discovered', 'generated', 'failures', *OUTCOME_OF.values(), 'seconds'))} FROM roll GROUP BY 1""",
)
def _(spark, sf):
    return C.run_log_by_day(C.run_log_rollup(_run_logs(spark, sf)))
