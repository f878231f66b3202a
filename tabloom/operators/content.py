"""Content resources: validation, scoring, duplicate risk, ranking, links, publishing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.operators.skew import top_per_key
from tabloom.schema import LIST_FIELDS
from tabloom.session import cut_lineage, written

# Allowed values and requirements of a resource.
INTENTS = ("informational", "transactional", "commercial", "navigational")
STATUSES = ("draft", "published", "noindex", "rejected")
TEMPLATES = (
    "file_conversion", "document_type", "workflow", "use_case", "comparison", "support_education", "guide",
    "industry_insight",
)
EDITORIAL = ("guide", "industry_insight")
# field, shortest and longest length
TEXT_BOUNDS = (
    ("slug", 3, 80), ("title", 10, 120), ("metaTitle", 10, 80), ("metaDescription", 50, 170), ("h1", 10, 100),
    ("primaryKeyword", 3, 10000), ("summary", 80, 10000),
)
REQUIRED = (
    "slug", "title", "metaTitle", "metaDescription", "h1", "primaryKeyword", "secondaryKeywords", "searchIntent",
    "templateType", "indexationStatus", "canonicalUrl", "hero", "summary", "whoItsFor", "whenThisIsRelevant",
    "supportedInputs", "expectedOutputs", "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "faq",
    "relatedResources", "relatedProductLinks", "trustSignals", "exampleUseCases", "qualityReview",
)
REQUIRED_EDITORIAL = (
    "slug", "title", "metaTitle", "metaDescription", "h1", "primaryKeyword", "secondaryKeywords", "searchIntent",
    "templateType", "indexationStatus", "canonicalUrl", "hero", "summary", "whoItsFor", "sections", "faq",
    "relatedResources", "qualityReview",
)
# template: smallest number of FAQ items, steps, challenges, limitations, sections; fields that must not be empty
TEMPLATE_RULES = {
    "file_conversion": (4, 3, 3, 2, 0, ("supportedInputs", "expectedOutputs", "howItWorksSteps", "commonChallenges",
                                        "whyItFits", "limitations", "faq")),
    "document_type": (4, 3, 3, 2, 0, ("whoItsFor", "supportedInputs", "expectedOutputs", "commonChallenges",
                                      "howItWorksSteps", "whyItFits", "limitations", "faq", "exampleUseCases")),
    "workflow": (3, 4, 2, 2, 0, ("whoItsFor", "whenThisIsRelevant", "howItWorksSteps", "whyItFits", "limitations", "faq")),
    "use_case": (3, 3, 2, 2, 0, ("whoItsFor", "whenThisIsRelevant", "supportedInputs", "expectedOutputs",
                                 "howItWorksSteps", "whyItFits", "limitations", "faq", "exampleUseCases")),
    "comparison": (4, 3, 3, 3, 0, ("whoItsFor", "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "faq")),
    "support_education": (3, 4, 1, 1, 0, ("whoItsFor", "howItWorksSteps", "faq", "limitations")),
    "guide": (4, 0, 0, 2, 4, ("whoItsFor", "sections", "faq", "limitations")),
    "industry_insight": (3, 0, 0, 0, 4, ("whoItsFor", "sections", "faq")),
}
DEFAULT_RULE = (3, 3, 2, 2, 0, ())
EXPECTED_TEMPLATES = {
    "transactional": ("file_conversion", "document_type"),
    "commercial": ("comparison", "use_case"),
    "informational": ("support_education", "workflow", "guide", "industry_insight"),
}
FILLERS = (
    "in today's digital world", "in this day and age", "it goes without saying", "as we all know", "game changer",
    "revolutionary", "cutting-edge", "state-of-the-art", "best-in-class", "world-class", "paradigm shift",
)
DISALLOWED = (
    "100% accuracy on all documents", "works perfectly on handwritten notes", "free unlimited processing",
    "replaces all manual data entry", "works offline", "stores documents permanently", "trains on user data",
)
EXAGGERATIONS = (
    "100% accurate", "100% accuracy", "never fails", "always perfect", "guaranteed results", "zero errors",
    "unlimited free", "completely free forever", "replaces all human", "no limitations",
)
FAKE_PROOF = (
    "customers say", "users report", "studies show", "research proves", "according to our data", "our customers love",
)
# gates for indexing, and the lenient ones for publishing without
GATES = {"intent": 70, "uniqueness": 80, "thin": 20, "duplication": 40, "truthfulness": 90, "helpfulness": 85}
LENIENT = {"truthfulness": 85, "helpfulness": 75, "duplication": 50}
PUBLISH_QUOTA, INDEX_QUOTA = 5, 3


def _n(field: str) -> Column:
    return F.greatest(F.size(F.col(field)), F.lit(0))


def _collect(checks: list[Column]) -> Column:
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def validate_resources(df: DataFrame) -> DataFrame:
    """Adds `errors`. Missing required fields end the check; otherwise every rule adds its finding."""
    editorial = F.coalesce(F.col("templateType").isin(*EDITORIAL), F.lit(False))

    def missing(names: tuple[str, ...]) -> Column:
        return _collect([F.when(F.col(n).isNull(), F.lit(f"Missing required field: {n}")) for n in names])

    absent = F.when(editorial, missing(REQUIRED_EDITORIAL)).otherwise(missing(REQUIRED))
    checks = []
    for name, low, high in TEXT_BOUNDS:
        size = F.length(X.blank(name))
        checks += [
            F.when(size < low, F.concat(F.lit(f"{name} too short (min {low}, got "), size.cast("string"), F.lit(")"))),
            F.when(size > high, F.concat(F.lit(f"{name} too long (max {high}, got "), size.cast("string"), F.lit(")"))),
        ]
    for name, allowed in (("searchIntent", INTENTS), ("templateType", TEMPLATES), ("indexationStatus", STATUSES)):
        checks.append(F.when(~F.col(name).isin(*allowed), F.concat(F.lit(f"Invalid {name}: "), F.col(name))))
    for name in (*LIST_FIELDS[:9], "faq", *LIST_FIELDS[9:]):
        checks.append(F.when(F.col(name).isNull(), F.lit(f"{name} must be an array")))
    for part in ("headline", "subheadline", "primaryCta"):
        checks.append(F.when(X.blank(F.col(f"hero.{part}")) == "", F.lit(f"hero.{part} is required")))
    for part in ("intentMatchScore", "uniquenessScore", "thinContentRisk", "duplicationRisk", "productTruthfulnessScore", "helpfulnessScore"):
        value = F.col(f"qualityReview.{part}")
        checks += [
            F.when(value.isNull(), F.lit(f"qualityReview.{part} must be a number")),
            F.when(~value.between(0, 100), F.lit(f"qualityReview.{part} must be 0-100")),
        ]
    advice = F.col("qualityReview.indexRecommendation")
    checks.append(F.when(~F.coalesce(advice.isin("index", "noindex"), F.lit(False)), F.lit("qualityReview.indexRecommendation invalid")))
    checks.append(
        F.when(
            (X.blank("slug") != "") & ~F.col("slug").rlike("^[a-z0-9][a-z0-9-]*[a-z0-9]$"),
            F.lit("slug must be lowercase alphanumeric with hyphens, not starting/ending with hyphen"),
        )
    )

    def placed(field: str, a: str, b: str, body: bool) -> Column:
        def judge(item: Column, i: Column) -> Column:
            at = F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("]"))
            finding = F.when((X.blank(item[a]) == "") | (X.blank(item[b]) == ""), F.concat(at, F.lit(f" missing {a} or {b}")))
            if body:
                size = F.length(item[b])
                finding = finding.when(
                    size < 100, F.concat(at, F.lit(" body too short (min 100 chars, got "), size.cast("string"), F.lit(")"))
                )
            return finding
        found = F.filter(F.transform(F.col(field), judge), lambda e: e.isNotNull())
        return F.coalesce(found, F.array().cast("array<string>"))

    rest = F.concat(_collect(checks), placed("faq", "question", "answer", False), placed("sections", "heading", "body", True))
    return df.withColumn("errors", F.when(F.size(absent) > 0, absent).otherwise(rest))


def _rule(position: int) -> Column:
    choice = F.lit(DEFAULT_RULE[position])
    for template, rule in TEMPLATE_RULES.items():
        choice = F.when(F.col("templateType") == template, rule[position]).otherwise(choice)
    return choice


def _bounded(score: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), score))


def _points(checks: list[tuple[Column, int, Column | str | None]]) -> tuple[Column, list[Column]]:
    """Sum of points of the checks that hold, and their reasons."""
    total, reasons = F.lit(0), []
    for test, points, reason in checks:
        total = total + F.when(test, points).otherwise(0)
        if reason is not None:
            reasons.append(F.when(test, reason if isinstance(reason, Column) else F.lit(reason)))
    return total, reasons


def _all_text() -> Column:
    lists = [
        F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
        for c in ("whoItsFor", "whenThisIsRelevant", "supportedInputs", "expectedOutputs", "commonChallenges", "howItWorksSteps",
                  "whyItFits", "limitations", "exampleUseCases", "trustSignals")
    ]

    def paired(c: str, a: str, b: str) -> Column:
        joined = F.transform(c, lambda p: F.concat_ws(" ", p[a], p[b]))
        return F.array_join(F.coalesce(joined, F.array().cast("array<string>")), " ")

    pairs = [paired("faq", "question", "answer"), paired("sections", "heading", "body")]
    return F.lower(F.concat_ws(" ", *[X.blank(c) for c in ("title", "summary", "h1", "metaDescription")], *lists, *pairs))


def resource_scores(df: DataFrame) -> DataFrame:
    """Five scores from 0 to 100 with reasons; a projection over nested columns."""
    keyword, summary = F.lower(X.blank("primaryKeyword")), F.lower(X.blank("summary"))
    no_answers = F.array().cast("array<string>")
    answers = F.coalesce(F.transform("faq", lambda f: X.blank(f["answer"])), no_answers)
    bodies = F.coalesce(F.transform("sections", lambda s: X.blank(s["body"])), no_answers)
    base = df.withColumn("_text", F.explode(F.array(_all_text())))
    shorts = F.size(F.filter(answers, lambda a: F.length(a) < 50))

    def total_chars(texts: Column) -> Column:
        return F.aggregate(texts, F.lit(0).cast("bigint"), lambda n, t: n + F.length(t))

    intent_checks = [
        ((keyword != "") & ~X.keyword_present(keyword, F.col(c)), p, f"Primary keyword not in {label}")
        for c, p, label in (("title", -15, "title"), ("h1", -10, "H1"), ("summary", -10, "summary"), ("metaDescription", -10, "meta description"))
    ]
    off_template = X.any_of(
        (F.col("searchIntent") == i) & ~F.coalesce(F.col("templateType").isin(*ts), F.lit(False)) for i, ts in EXPECTED_TEMPLATES.items()
    )
    intent, r1 = _points([*intent_checks, (off_template, -5, None)])

    def mean_len(c: str) -> Column:
        return F.when(_n(c) > 0, total_chars(F.transform(c, X.blank)) / F.size(c))

    unique, r2 = _points(
        [(shorts * 2 > F.size(answers), -20, "Many FAQ answers are too short to be useful")]
        + [(summary.contains(p), -10, f"Generic filler phrase detected: '{p}'") for p in FILLERS]
        + [
            (F.coalesce(mean_len(c) < 30, F.lit(False)), -10, F.concat(F.lit(f"{c} items are too short (avg "), F.format_string("%.0f", mean_len(c)), F.lit(" chars)")))
            for c in ("whyItFits", "commonChallenges", "howItWorksSteps")
        ]
    )

    counts = [_n("faq"), _n("howItWorksSteps"), _n("commonChallenges"), _n("limitations")]
    labels = ("FAQ items", "how-it-works steps", "challenges", "limitations")
    thin_checks = [
        (n < _rule(i), p, F.concat(F.lit(f"Too few {label} ("), n.cast("string"), F.lit(" < "), _rule(i).cast("string"), F.lit(")")))
        for i, (n, p, label) in enumerate(zip(counts, (15, 15, 10, 15), labels))
    ]
    needed = sorted({f for rule in TEMPLATE_RULES.values() for f in rule[5]})
    for f in needed:
        asks = F.col("templateType").isin(*[t for t, rule in TEMPLATE_RULES.items() if f in rule[5]])
        thin_checks.append((F.coalesce(asks, F.lit(False)) & (_n(f) == 0), 10, f"Required field '{f}' is empty for template type"))
    thin_checks.append((F.length(X.blank("summary")) < 100, 15, "Summary too short (< 100 chars)"))
    sections, chars = _n("sections"), total_chars(bodies)
    items = sum(
        (_n(c) for c in ("whoItsFor", "whenThisIsRelevant", "supportedInputs", "expectedOutputs", "commonChallenges", "howItWorksSteps",
                         "whyItFits", "limitations", "faq", "exampleUseCases")), F.lit(0)
    )
    thin_checks += [
        ((sections > 0) & (sections < _rule(4)), 15, F.concat(F.lit("Too few article sections ("), sections.cast("string"), F.lit(" < "), _rule(4).cast("string"), F.lit(")"))),
        ((sections > 0) & (chars < 600), 15, F.concat(F.lit("Article body too short ("), chars.cast("string"), F.lit(" total chars)"))),
        ((sections == 0) & (items < 15), 15, F.concat(F.lit("Total content items too low ("), items.cast("string"), F.lit(")"))),
    ]
    thin, r3 = _points(thin_checks)

    text = F.col("_text")
    truth, r4 = _points(
        [(text.contains(p), -20, f"Disallowed claim detected: '{p}'") for p in DISALLOWED]
        + [(text.contains(p), -15, f"Exaggeration detected: '{p}'") for p in EXAGGERATIONS]
        + [(text.contains(p), -10, f"Potential fake social proof: '{p}'") for p in FAKE_PROOF]
        + [(_n("limitations") < 1, -15, "No limitations mentioned - likely not truthful")]
    )

    editorial = F.coalesce(F.col("templateType").isin(*EDITORIAL), F.lit(False))
    depth = F.when(sections > 0, chars / sections)
    repeats = F.when(keyword != "", F.floor((F.length(summary) - F.length(F.replace(summary, keyword, F.lit("")))) / F.length(keyword))).otherwise(0)
    help_, r5 = _points(
        [
            (_n("faq") >= 4, 8, None), ((_n("faq") > 0) & (shorts == 0), 5, None),
            (editorial & (sections >= 4), 10, None), (editorial & (sections == 3), 6, None),
            (editorial & F.coalesce(depth >= 300, F.lit(False)), 10, None),
            (editorial & F.coalesce((depth >= 150) & (depth < 300), F.lit(False)), 5, None),
            (editorial & F.coalesce(depth < 150, F.lit(False)), 0,
             F.concat(F.lit("Article sections too shallow (avg "), F.format_string("%.0f", depth), F.lit(" chars)"))),
            (_n("whoItsFor") >= 2, 5, None), (~editorial & (_n("howItWorksSteps") >= 3), 8, None),
            (~editorial & (_n("limitations") >= 2), 8, None), (~editorial & (_n("exampleUseCases") >= 2), 5, None),
            (~editorial & (_n("trustSignals") >= 2), 3, None), (_n("relatedResources") >= 1, 3, None),
            (repeats > 4, -15, F.concat(F.lit("Keyword stuffing in summary ("), repeats.cast("string"), F.lit(" occurrences)"))),
        ]
    )
    scored = {
        "intent": _bounded(intent + 100), "uniqueness": _bounded(unique + 100), "thin": _bounded(thin),
        "truthfulness": _bounded(truth + 100), "helpfulness": _bounded(help_ + 60),
    }
    return base.select(*df.columns, *[c.alias(n) for n, c in scored.items()], _collect(r1 + r2 + r3 + r4 + r5).alias("reasons"))


def read_time(df: DataFrame) -> DataFrame:
    """Minutes to read at 230 words each, rounded half to even, at least one."""
    def words(texts: Column) -> Column:
        return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0), lambda n, t: n + X.word_count(t))

    total = X.word_count("summary") + words(F.transform("sections", lambda s: s["body"])) + words(F.transform("faq", lambda f: f["answer"]))
    for c in ("whoItsFor", "commonChallenges", "howItWorksSteps", "whyItFits", "limitations", "exampleUseCases"):
        total = total + words(F.col(c))
    return df.select("slug", total.alias("words"), F.greatest(F.lit(1), F.bround(total / 230).cast("int")).alias("minutes"))


# --- duplicate risk --------------------------------------------------------------------------------------------------

#: Words of 64 bits in the bitmap of a set.
BITMAP = 4
#: A token in fewer sets counts as rare, whatever the number; the others are told apart by it. Only speed depends on it.
FREQUENT = 8
#: Frequent tokens (two numbers each) that are sent to every executor, at most; beyond that they meet the sets by a shuffle.
SENT_TOKENS = 1_000_000


def _sides(df: DataFrame, candidate: bool, corpus: bool) -> DataFrame:
    """The texts that are compared, one row per resource, marked with the sides that it stands on."""
    told = [F.lower(X.blank(c)) for c in ("primaryKeyword", "title", "summary")]
    # a title is the same as another one if its distinct words are
    texts = [F.array_join(F.array_sort(X.content_words(c)), " ").alias(c) for c in ("title", "summary")]
    return df.select(
        "slug", told[0].alias("keyword"), X.blank("templateType").alias("template"), *texts,
        F.lit(candidate).alias("asked"), F.lit(corpus).alias("given"),
    )


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Per distinct value: is it some candidate's, and the least and greatest slug of the corpus that carries it, by their hash.

    Only whether a slug differs from another one is asked later, so the numbers stand for the slugs.
    """
    slug = F.when(F.col("given") & F.col("slug").isNotNull(), F.xxhash64("slug"))
    return rows.groupBy(*keys).agg(
        F.max("asked").alias("asked"), F.max("given").alias("given"), F.min(slug).alias("low"), F.max(slug).alias("high")
    )


def _postings(sets: DataFrame, at_least: float, carried: list[str]) -> DataFrame:
    """Index rows of sets (id, tokens): their rarest tokens with place, the set's size and band of size, a bitmap of its tokens,
    and the carried columns."""
    often = cut_lineage(
        sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    )
    # a set is dealt once: its tokens are opened, counted and put together again where it lies
    opened = sets.select("id", *carried, "tokens").repartition("id").select("id", *carried, F.explode("tokens").alias("token"))
    listed = opened.join(F.broadcast(often) if often.count() <= SENT_TOKENS else often, "token", "left")
    bit = F.pmod(F.col("token"), F.lit(64 * BITMAP))
    words = [
        F.bit_or(F.when(F.floor(bit / 64) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}")
        for k in range(BITMAP)
    ]
    # one set's own tokens, at most the words of one text
    ranked = listed.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ranked"),
        *words, *[F.first(c).alias(c) for c in carried],
    )
    size = F.size("ranked")
    prefix = F.slice(F.transform("ranked", lambda r: r["token"]), F.lit(1), size - F.ceil(size * at_least - 1e-9).cast("int") + 1)
    return ranked.select(
        "id", *carried, size.alias("size"), *[f"m{k}" for k in range(BITMAP)],
        F.floor(F.log(size) / -math.log(at_least)).alias("band"), F.posexplode(prefix).alias("place", "token"),
    )


def _meet(sets: DataFrame, at_least: float, carried: list[str]) -> DataFrame:
    """Pairs of different sets, one of a candidate and one of the corpus, whose Jaccard similarity may reach `at_least`; none that
    does is missing. A pair comes once per shared rare token, the smaller set left.

    Sets that similar share one of their rarest tokens and lie in the same or neighbouring bands of size, so rows meet on token and
    band. What can still be shared from the place of a shared token on, and the bits in which the bitmaps differ, bound the
    overlap.
    """
    rows = _postings(sets, at_least, ["asked", "given", *carried])
    left, right = (rows.select("token", "band", *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c not in ("token", "band")]) for s in ("left", "right"))
    right = right.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    sizes = F.col("left_size") + F.col("right_size")
    need = F.ceil(sizes * (at_least / (1 + at_least)) - 1e-9)
    rest = F.least(F.col("left_size") - F.col("left_place"), F.col("right_size") - F.col("right_place")) - 1
    differ = sum((F.bit_count(F.col(f"left_m{k}").bitwiseXOR(F.col(f"right_m{k}"))) for k in range(BITMAP)), F.lit(0))
    first = (F.col("left_size") < F.col("right_size")) | ((F.col("left_size") == F.col("right_size")) & (F.col("left_id") < F.col("right_id")))
    sides = (F.col("left_asked") & F.col("right_given")) | (F.col("left_given") & F.col("right_asked"))
    return left.join(right, ["token", "band"]).filter(
        first & sides & (F.col("left_size") >= F.col("right_size") * at_least - 1e-9)
        & (F.least("left_place", "right_place") + 1 + rest >= need) & (sizes - differ >= need * 2)
    ).withColumns({"need": need, "rest": rest})


def _close(sets: DataFrame, at_least: float) -> DataFrame:
    """Pairs (left_id, right_id) that may reach `at_least`, each once: the number of shared rare tokens and the place of the last one
    bound the overlap as well."""
    grouped = _meet(sets, at_least, []).groupBy("left_id", "right_id").agg(
        F.count("*").alias("shared"), F.min("rest").alias("rest"), F.first("need").alias("need")
    )
    return grouped.filter(F.col("shared") + F.col("rest") >= F.col("need")).select("left_id", "right_id")


def candidate_sets(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """Pairs (left_id, right_id) of sets (id, tokens) whose Jaccard similarity may reach `at_least`; none that does is missing.

    Sets of the same tokens are compared once, and come together without a comparison.
    """
    def members(df: DataFrame, asked: bool) -> DataFrame:
        tokens = F.array_sort(F.transform(F.array_distinct("tokens"), lambda w: F.xxhash64(w)))
        return df.filter(F.size("tokens") > 0).select(
            F.col("id").alias("member"), tokens.alias("tokens"), F.lit(asked).alias("asked"), F.lit(not asked).alias("given")
        ).withColumn("id", F.xxhash64("tokens"))

    a, b = members(left, True), members(right, False)
    sets = written(a.unionByName(b).groupBy("id", "tokens").agg(F.max("asked").alias("asked"), F.max("given").alias("given")), "candidate-sets")
    close = _close(sets, at_least)
    ways = close.unionByName(close.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    same = sets.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"))
    lefts = a.select(F.col("id").alias("left_id"), F.col("member").alias("left_member"))
    rights = b.select(F.col("id").alias("right_id"), F.col("member").alias("right_member"))
    return ways.unionByName(same).join(lefts, "left_id").join(rights, "right_id").select(
        F.col("left_member").alias("left_id"), F.col("right_member").alias("right_id")
    )


def _levels(pairs: DataFrame, hits: Column) -> DataFrame:
    """Least and greatest slug per candidates' value, risk and signal, from pairs and their hits; a pair counts both ways."""
    ways = F.array(*[
        F.struct(F.col(f"{a}_id").alias("id"), (F.col(f"{a}_asked") & F.col(f"{b}_given")).alias("counts"), F.col(f"{b}_low").alias("low"), F.col(f"{b}_high").alias("high"))
        for a, b in (("left", "right"), ("right", "left"))
    ])
    found = pairs.select("left_id", "right_id", ways.alias("ways"), F.explode(hits).alias("hit")).select(F.inline("ways"), "hit.risk", "hit.signal")
    return found.filter("counts").groupBy("id", "risk", "signal").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _overlap(shared: Column) -> Column:
    return shared / (F.size("left_tokens") + F.size("right_tokens") - shared)


def _keyword_levels(units: DataFrame) -> DataFrame:
    """Levels of keywords (with their template): these are short, so their tokens travel with the index rows, pairs are settled
    where they meet, and only levels are shuffled."""
    # the generator counts a pair's common tokens once, not in every test
    pairs = _meet(units, 0.6, ["tokens", "words", "text", "template", "low", "high"]).select(
        "*", F.explode(F.array(F.size(F.array_intersect("left_tokens", "right_tokens")))).alias("shared")
    )
    alike, other_text = _overlap(F.col("shared")), F.col("left_text") != F.col("right_text")
    same_type = F.col("left_template") == F.col("right_template")
    only = [F.size(f"{s}_tokens") - F.col("shared") == 1 for s in ("left", "right")]
    swap = (F.col("left_words") == F.col("right_words")) & only[0] & only[1] & (F.col("shared") >= 3)
    hits = F.array(
        F.when(other_text & (alike > 0.85), F.struct(F.when(same_type, 70).otherwise(60).alias("risk"), F.lit("keyword_very_high").alias("signal"))),
        F.when(other_text & (alike > 0.7) & (alike <= 0.85), F.struct(F.when(same_type, 45).otherwise(30).alias("risk"), F.lit("keyword_moderate").alias("signal"))),
        F.when(swap, F.struct(F.when(same_type, 60).otherwise(35).alias("risk"), F.lit("keyword_swap").alias("signal"))),
    )
    return _levels(pairs, F.filter(hits, lambda h: h.isNotNull()))


def _text_levels(sets: DataFrame, above: float, risk: int, signal: str) -> DataFrame:
    """Levels of longer texts: pairs are grouped as numbers, then meet the tokens of both sides. Copies of one set are alike
    without a comparison."""
    pairs = _close(sets, above)
    for side in ("left", "right"):
        pairs = pairs.join(sets.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "asked", "given", "low", "high", "tokens")]), f"{side}_id")
    alike = pairs.filter(_overlap(F.size(F.array_intersect("left_tokens", "right_tokens"))) > above)
    hit = F.struct(F.lit(risk).alias("risk"), F.lit(signal).alias("signal"))
    own = sets.filter("asked and given").select("id", F.lit(risk).alias("risk"), F.lit(signal).alias("signal"), "low", "high")
    return _levels(alike, F.array(hit)).unionByName(own)


def duplicate_risk(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Highest duplicate risk of each candidate against all other resources, and the kinds of likeness found.

    Columns used: slug, templateType, primaryKeyword, title, summary. Values are compared per distinct value, not per
    resource; per value at most one row per kind and level of risk is kept, so many copies of one text stay cheap. Values, words
    and slugs are told apart by 64-bit hashes. What several steps read is written once, in columns.
    """
    if corpus is candidates:
        rows = _sides(candidates, True, True)
    else:
        rows = _sides(candidates, True, False).unionByName(_sides(corpus, False, True))
    rows = written(rows, "risk-rows")
    asked = rows.filter("asked").select("slug", *[F.xxhash64(*c).alias(f"{n}_id") for n, c in (
        ("exact", ["keyword"]), ("keyword", ["keyword", "template"]), ("title", ["title"]), ("summary", ["summary"]),
    )])

    exact = _spread(rows.filter("keyword != ''"), "keyword").filter("asked and given").select(
        F.xxhash64("keyword").alias("id"), F.lit(90).alias("risk"), F.lit("keyword_exact").alias("signal"), "low", "high"
    )
    # word order and repeats matter for the swap test, so a keyword keeps its number of words
    units = written(_spread(rows, "keyword", "template").select(
        F.xxhash64("keyword", "template").alias("id"), "asked", "given", "low", "high", "template", F.xxhash64("keyword").alias("text"),
        F.size(X.content_words("keyword", False)).alias("words"), F.transform(X.content_words("keyword"), lambda w: F.xxhash64(w)).alias("tokens"),
    ).filter(F.size("tokens") > 0), "risk-keywords")

    def sets(column: str) -> DataFrame:
        spread = _spread(rows.filter(F.col(column) != ""), column)
        tokens = F.transform(F.split(column, " "), lambda w: F.xxhash64(w))
        return written(spread.select(F.xxhash64(column).alias("id"), "asked", "given", "low", "high", tokens.alias("tokens")), f"risk-{column}")

    levels = {
        "exact": exact, "keyword": _keyword_levels(units),
        "title": _text_levels(sets("title"), 0.8, 60, "title"), "summary": _text_levels(sets("summary"), 0.75, 50, "summary"),
    }
    own = F.xxhash64("slug")
    risks = None
    for name, level in levels.items():
        # without the levels that only a candidate's own slug causes
        hits = asked.select("slug", F.col(f"{name}_id").alias("id")).filter(F.col("slug").isNotNull()).join(level, "id").filter(
            (F.col("low") != own) | (F.col("high") != own)
        ).select("slug", "risk", "signal")
        risks = hits if risks is None else risks.unionByName(hits)
    worst = risks.groupBy("slug").agg(F.max("risk").alias("risk"), F.array_sort(F.collect_set("signal")).alias("signals"))
    joined = rows.filter("asked").select("slug").distinct().join(worst, "slug", "left")
    return joined.select(
        "slug", F.coalesce("risk", F.lit(0)).alias("duplication"),
        F.coalesce("signals", F.array().cast("array<string>")).alias("signals"),
    )


def _told(df: DataFrame) -> dict[str, Column]:
    """What a resource is compared by: its keyword, and the words of keyword, title and summary."""
    keyword, title, summary = (F.lower(X.blank(c)) for c in ("primaryKeyword", "title", "summary"))
    return {
        "_keyword": keyword, "_template": X.blank("templateType"), "_all_words": F.size(X.content_words(keyword, False)),
        "_keyword_words": X.content_words(keyword), "_title_words": X.content_words(title), "_summary_words": X.content_words(summary),
    }


def _risk_against(row, shared: Column) -> Column:
    """Risk of every resource against one given resource, from the numbers of words they share; zero for itself."""
    def likeness(kind: str) -> Column:
        n, size = shared[kind], len(row[f"_{kind}_words"])
        own = F.size(f"_{kind}_words")
        return F.when((own == 0) | F.lit(size == 0), F.lit(0.0)).otherwise(n / (own + size - n))

    same_type, near, n = F.col("_template") == F.lit(row["_template"]), likeness("keyword"), shared["keyword"]
    by_keyword = (
        F.when((F.col("_keyword") != "") & (F.col("_keyword") == F.lit(row["_keyword"])), 90)
        .when(near > 0.85, F.when(same_type, 70).otherwise(60)).when(near > 0.7, F.when(same_type, 45).otherwise(30)).otherwise(0)
    )
    swap = (
        (F.col("_all_words") == row["_all_words"]) & (F.size("_keyword_words") - n == 1)
        & (len(row["_keyword_words"]) - n == 1) & (n >= 3)
    )
    risk = F.greatest(
        by_keyword, F.when(likeness("title") > 0.8, 60).otherwise(0), F.when(likeness("summary") > 0.75, 50).otherwise(0),
        F.when(swap, F.when(same_type, 60).otherwise(35)).otherwise(0),
    )
    return F.when(F.col("slug") == F.lit(row["slug"]), 0).otherwise(risk)


def _with_risk(rows: DataFrame, accepted: list, order: str) -> DataFrame:
    """`rows` with `risk` raised by the accepted resources that come before; each pair is compared once, in generators."""
    def shared(row) -> Column:
        return F.struct(*[
            F.size(F.array_intersect(f"_{k}_words", F.array(*map(F.lit, row[f"_{k}_words"])).cast("array<string>"))).alias(k)
            for k in ("keyword", "title", "summary")
        ])

    if not accepted:
        return rows
    counted = rows.select("*", F.inline(F.array(F.struct(*[shared(row).alias(f"_shared{i}") for i, row in enumerate(accepted)]))))
    raised = [
        F.when(F.col(order) > F.lit(row[order]), _risk_against(row, F.col(f"_shared{i}"))) for i, row in enumerate(accepted)
    ]
    risk = F.explode(F.array(F.greatest("risk", *raised))).alias("risk")
    return counted.select(*[c for c in rows.columns if c != "risk"], risk)


def publish_decisions(
    candidates: DataFrame, corpus: DataFrame, order: str, publish_quota: int = PUBLISH_QUOTA, index_quota: int = INDEX_QUOTA
) -> DataFrame:
    """Decide every candidate in `order`: rejected, draft, published or noindex.

    Decisions change later ones only through the few accepted candidates: each adds one resource to compare with and
    counts for the quotas. So the scores are computed once for all and written with the words that are compared; then the
    first acceptable candidate is looked up, at most `publish_quota` times, and the others fall into place by position.
    """
    scored = resource_scores(validate_resources(candidates)).withColumnRenamed("reasons", "score_reasons")
    strict = (
        (F.col("intent") >= GATES["intent"]) & (F.col("uniqueness") >= GATES["uniqueness"]) & (F.col("thin") <= GATES["thin"])
        & (F.col("truthfulness") >= GATES["truthfulness"]) & (F.col("helpfulness") >= GATES["helpfulness"])
    )
    loose = (F.col("truthfulness") >= LENIENT["truthfulness"]) & (F.col("helpfulness") >= LENIENT["helpfulness"])
    texts = ["slug", "templateType", "primaryKeyword", "title", "summary"]
    told = _told(scored)
    # the wide candidates are read in this pass only
    state = written(scored.select(
        order, *texts, (F.size("errors") == 0).alias("_valid"), strict.alias("_strict"), loose.alias("_loose"),
        *[c.alias(n) for n, c in told.items()],
    ), "publish-scores")
    risks = duplicate_risk(state.select(*texts), corpus).select("slug", F.col("duplication").alias("risk"))
    state = written(state.select(order, "slug", "_valid", "_strict", "_loose", *told).join(risks, "slug"), "publish-state")

    strict = F.col("_strict") & (F.col("risk") <= GATES["duplication"])
    loose = F.col("_loose") & (F.col("risk") <= LENIENT["duplication"])
    accepted, indexed, kinds = [], 0, []
    while len(accepted) < publish_quota:
        open_gates = (strict if indexed < index_quota else F.lit(False)) | loose
        # risks only rise: who fails now fails later, so few are compared again
        ahead = state.filter(F.col("_valid") & open_gates)
        if accepted:
            ahead = ahead.filter(F.col(order) > accepted[-1][order])
        row = _with_risk(ahead, accepted, order).filter(open_gates).select("*", strict.alias("_indexed")).orderBy(order).limit(1).collect()
        if not row:
            break
        outcome = "published" if row[0]["_indexed"] and indexed < index_quota else "noindex"
        indexed += outcome == "published"
        # from here on the accepted one is part of what later candidates are compared with
        accepted.append(row[0])
        kinds.append(outcome)
    closed = F.col(order) > F.lit(accepted[-1][order]) if len(accepted) == publish_quota else F.lit(False)
    outcome = F.when(~F.col("_valid"), "rejected")
    for row, kind in zip(accepted, kinds, strict=True):
        outcome = outcome.when(F.col(order) == F.lit(row[order]), kind)
    outcome = outcome.when(closed, "draft").when(~strict, "rejected").otherwise("draft")
    return _with_risk(state, accepted, order).select(order, "slug", F.col("risk").alias("duplication"), outcome.alias("decision"))


# --- listing, ranking, links -----------------------------------------------------------------------------------------

def search_resources(df: DataFrame, text: str) -> DataFrame:
    """Listed resources with the text in title, description or keyword, in any case."""
    listed = df.filter(F.col("indexationStatus").isin("published", "noindex"))
    if not text.strip():
        return listed
    needle = text.lower()
    return listed.filter(X.any_of(F.lower(X.blank(c)).contains(needle) for c in ("title", "metaDescription", "primaryKeyword")))


def recent(df: DataFrame, n: int = 6) -> DataFrame:
    return df.orderBy(F.desc("publishedAt"), F.col("slug")).limit(n)


def listed_by_type(df: DataFrame) -> DataFrame:
    """Number of listed resources per type."""
    return df.groupBy("templateType").agg(F.count("*").alias("resources"))


def all_slugs(*parts: DataFrame) -> DataFrame:
    """Union of identifiers."""
    out = parts[0].select("slug")
    for part in parts[1:]:
        out = out.union(part.select("slug"))
    return out.distinct()


def uncovered(topics: DataFrame, slugs: DataFrame) -> DataFrame:
    """Topics whose slug is not taken."""
    return topics.join(slugs.select("slug"), "slug", "left_anti")


def retry_drafts(new: DataFrame, drafts: DataFrame) -> DataFrame:
    """New candidates, then the drafts whose slug is not among them."""
    return new.unionByName(drafts.join(new.select("slug"), "slug", "left_anti"))


def rank_topics(topics: DataFrame, covered: DataFrame, k: int) -> DataFrame:
    """Best k open topics (slug, template, intent, cluster, priority); full clusters lose points."""
    taken = topics.join(covered.select("slug").distinct(), "slug").groupBy("cluster").agg(F.count("*").alias("taken"))
    open_topics = uncovered(topics, covered).join(taken, "cluster", "left")
    n = F.coalesce("taken", F.lit(0))
    # Points by template, intent and cluster size.
    bonus = F.when(F.col("template").isin("file_conversion", "document_type"), 10).when(F.col("template").isin(*EDITORIAL), 8).otherwise(0)
    wish = F.when(F.col("intent") == "transactional", 5).when(F.col("intent") == "informational", 3).otherwise(0)
    full = F.when(n >= 5, 15).when(n >= 3, 5).otherwise(0)
    scored = open_topics.select(*topics.columns, (F.col("priority") * 10 + bonus + wish - full).alias("opportunity"))
    return scored.orderBy(F.desc("opportunity"), F.desc("priority"), F.col("slug")).limit(k)


def related_items(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Up to four related slugs per candidate: two of its type, then one of each other type in type order.

    corpus: (slug, templateType, ord). Only the first items per type can ever be linked (one may be the candidate
    itself), so these few meet the candidates, not the corpus.
    """
    types = corpus.groupBy("templateType").agg(F.min("ord").alias("type_ord"))
    # at most three rows per type
    heads = top_per_key(corpus.select("slug", "templateType", "ord"), ["templateType"], [F.col("ord")], 3)
    per_type = heads.groupBy("templateType").agg(F.array_sort(F.collect_list(F.struct("ord", "slug"))).alias("items")).join(types, "templateType")
    # besides its own type a candidate links into at most four of the first five types: fifteen slugs at most
    shelf = per_type.orderBy("type_ord").limit(5).collect()
    own = candidates.select("slug", "templateType").join(per_type.select("templateType", F.col("items").alias("own_items")), "templateType", "left")
    own_slugs = F.coalesce(F.transform("own_items", lambda i: i["slug"]), F.array().cast("array<string>"))
    same = F.slice(F.filter(own_slugs, lambda s: s != F.col("slug")), 1, 2)

    def pick(row) -> Column:
        slugs = F.array(*[F.lit(i["slug"]) for i in row["items"]])
        first = F.get(F.filter(slugs, lambda s: s != F.col("slug")), F.lit(0))
        return F.when(~F.col("templateType").eqNullSafe(F.lit(row["templateType"])), first)

    linked = F.concat(same, _collect([pick(row) for row in shelf])) if shelf else same
    return own.select("slug", F.slice(linked, 1, 4).alias("related"))


def run_log_rollup(flat: DataFrame) -> DataFrame:
    """Figures per run from flattened run logs."""
    def total(outcome: str) -> Column:
        return F.sum((F.col("outcome") == outcome).cast("bigint"))

    seconds = F.unix_timestamp(F.try_to_timestamp("completed")) - F.unix_timestamp(F.try_to_timestamp("started"))
    return flat.groupBy("run_id").agg(
        F.to_date(F.try_to_timestamp(F.max("started"))).cast("string").alias("run_date"),
        F.max("discovered").alias("discovered"), F.max("generated").alias("generated"), F.max("failures").alias("failures"),
        *[F.coalesce(total(o), F.lit(0)).alias(o) for o in ("published_index", "published_noindex", "drafted", "rejected")],
        F.max(seconds).alias("seconds"),
    )


def run_log_by_day(rollup: DataFrame) -> DataFrame:
    """Figures per day."""
    numbers = ("discovered", "generated", "failures", "published_index", "published_noindex", "drafted", "rejected", "seconds")
    return rollup.groupBy("run_date").agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in numbers])
