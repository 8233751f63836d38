"""Plain-language questions: a question becomes an explicit plan, a plan a Spark aggregation.

Routing is a column expression, so one question and a table of questions share it.
The plan has four fields: intent, dimension, measure and n.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyforge.functions import lookups as L
from tallyforge.functions.ordered import bucketed_previous, bucketed_running_max
from tallyforge.functions.semantics import col, numeric_columns, percent, text_columns, time_columns
from tallyforge.functions.text import contains_any, format_value, humanize_name
from tallyforge.operators import backbone as B, grouped as G, profile as P, trend as TR
from tallyforge.operators.language import normalize_question, normalize_spoken
from tallyforge.plans.answers import ANSWER, KEYS, answer_plans
from tallyforge.session import staged_table

_ROLES = L.QUESTION_ROLES


def _plain(name: str) -> str:
    return name.lower().replace("_", " ")


def first_match(columns: list[str], words: list[str]) -> str | None:
    """First column that holds the earliest keyword; the first column when none does."""
    hits = (c for w in words for c in columns if w in _plain(c))
    return next(hits, columns[0] if columns else None)


class Router:
    """The columns of one table and the rules that map a question to them."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self.numbers = numeric_columns(df)
        self.texts = text_columns(df)
        self.times = [c for c in df.columns if "date" in c.lower() or "time" in c.lower() or c in time_columns(df)]

    def available(self, role: str) -> bool:
        return any(w in _plain(c) for c in self.columns for w in _ROLES[role])

    @staticmethod
    def requested(q: Column, role: str) -> Column:
        return contains_any(q, [role, *_ROLES[role]])

    @staticmethod
    def mentioned(q: Column, columns: list[str]) -> Column:
        """A column named in full, else one of whose words (over two letters) occurs."""
        q = F.translate(q, "_", " ")
        rules = [(F.contains(q, F.lit(_plain(c))), c) for c in columns]
        for c in columns:
            parts = [p for p in _plain(c).split() if len(p) > 2]
            if parts:
                rules.append((contains_any(q, parts), c))
        return F.coalesce(*[F.when(rule, F.lit(c)) for rule, c in rules], F.lit(None).cast("string"))

    def dimension(self, q: Column) -> Column:
        if not self.texts:
            return F.lit(None).cast("string")
        asked = [
            F.when(self.requested(q, role), F.lit(first_match(self.texts, _ROLES[role])))
            for role in ("product", "city", "customer", "category")
        ]
        return F.coalesce(*asked, self.mentioned(q, self.texts), F.lit(first_match(self.texts, L.CATEGORY_FALLBACK)))

    def metric_role(self, q: Column) -> Column:
        profit = "profit" if self.available("profit") else "revenue"
        return (
            F.when(self.requested(q, "profit"), profit).when(self.requested(q, "revenue"), "revenue")
            .when(self.requested(q, "quantity"), "quantity").when(self.requested(q, "discount"), "discount")
        )

    def measure(self, q: Column) -> Column:
        if not self.numbers:
            return F.lit(None).cast("string")
        role = self.metric_role(q)
        asked = [F.when(role == r, F.lit(first_match(self.numbers, _ROLES[r]))) for r in ("profit", "revenue", "quantity", "discount")]
        return F.coalesce(*asked, self.mentioned(q, self.numbers), F.lit(first_match(self.numbers, L.NUMERIC_FALLBACK)))

    def unknown_field(self, q: Column) -> Column:
        """A known kind of field is asked for that the table does not have."""
        missing = [
            r for r in _ROLES
            if not self.available(r) and not (r == "profit" and self.available("revenue"))
        ]
        return reduce(lambda a, b: a | b, [self.requested(q, r) for r in missing], F.lit(False))

    def plan(self, q: Column) -> Column:
        """The plan of a normalised question; rules are tested in order, the first that fits wins."""
        dimension, measure = self.dimension(q), self.measure(q)
        none = F.lit(None).cast("string")
        named_dimension = self.mentioned(q, self.texts) if self.texts else none
        named_measure = self.mentioned(q, self.numbers) if self.numbers else none
        top_dimension = F.coalesce(named_dimension, dimension)
        n = F.greatest(F.lit(1), F.least(F.lit(25), F.coalesce(
            F.regexp_extract(q, r"top\s+(\d+)", 1).try_cast("int"), F.lit(1)
        )))

        def make(intent: str, d: Column = none, m: Column = none, k: Column | None = None) -> Column:
            return F.struct(
                F.lit(intent).alias("intent"), d.alias("dimension"), m.alias("measure"),
                (F.lit(1) if k is None else k).cast("int").alias("n"),
            )

        def entity(role: str) -> Column:
            return make("unique_count", F.lit(first_match(self.columns, _ROLES[role])))

        counting = contains_any(q, L.COUNT_WORDS)
        by_segment = named_dimension.isNotNull() | reduce(
            lambda a, b: a | b, [self.requested(q, r) for r in ("category", "product", "city", "customer", "date")]
        )
        no_metric = named_measure.isNull() & self.metric_role(q).isNull()
        top = contains_any(q, L.TOP_WORDS)
        why = F.contains(q, F.lit("why")) & (self.requested(q, "profit") | self.requested(q, "revenue"))
        if not self.numbers or not self.times:
            why = F.lit(False)
        weak = contains_any(q, L.WEAK_WORDS) | (F.contains(q, F.lit("least")) & F.contains(q, F.lit("perform")))
        return (
            F.when(self.unknown_field(q), make("unknown"))
            .when(counting & self.requested(q, "product"), entity("product"))
            .when(counting & self.requested(q, "customer"), entity("customer"))
            .when(counting & F.contains(q, F.lit("order")), entity("order"))
            .when(why, make("why_change", dimension, measure))
            .when(weak, make("weakest", dimension, measure))
            .when(top & by_segment & (n > 1) & measure.isNotNull(), make("top_n", top_dimension, measure, n))
            .when(top & by_segment & no_metric, make("top_count", top_dimension, none, n))
            .when(top & by_segment & measure.isNotNull(), make("leader", top_dimension, measure))
            .when(top, make("highest_value", none, measure))
            .when(contains_any(q, L.AVERAGE_WORDS), make("average", none, measure))
            .when(contains_any(q, L.COMMON_WORDS), make("most_common", dimension))
            .when(contains_any(q, L.OUTLIER_WORDS), make("outliers", none, measure))
            .when(contains_any(q, L.ROW_WORDS), make("rows"))
            .when(contains_any(q, L.COLUMN_WORDS), make("columns"))
            .when(contains_any(q, L.QUALITY_WORDS), make("quality"))
            .when(contains_any(q, L.ADVICE_WORDS), make("advice", dimension, measure))
            .otherwise(make("unknown"))
        )


def resolve_columns(df: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with the dimension and measure column they mean and whether a field is unknown."""
    router = Router(df)
    q = F.col("_q")
    return questions.withColumn("_q", normalize_question(F.col("question"))).select(
        *questions.columns, router.dimension(q).alias("dimension"), router.measure(q).alias("measure"),
        router.unknown_field(q).alias("unknown_field"),
    )


def plan_questions(df: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with intent, dimension, measure and n."""
    # a column of its own: the rules name the normalised question some fifty times, and a plan that held all its replacements each time
    # would be large on the driver and slow on every row
    q, p = (_free(name, questions) for name in ("_q", "_p"))
    planned = questions.withColumn(q, normalize_question(F.col("question"))).withColumn(p, Router(df).plan(F.col(q)))
    return planned.select(*questions.columns, *[F.col(p)[k].alias(k) for k in KEYS])


def _free(name: str, df: DataFrame) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _answer(frame: DataFrame, kind: str, label, value, share, text) -> DataFrame:
    return frame.select(
        F.lit(kind).alias("answer_type"), (F.lit(None) if label is None else label).cast("string").alias("label"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        (F.lit(None) if share is None else share).cast("double").alias("share"), text.alias("text"),
    )


def _fmt(pattern: str, *args) -> Column:
    return F.format_string(pattern, *args)


def _unknown(df: DataFrame) -> DataFrame:
    one = df.sparkSession.range(1)
    return _answer(one, "unknown", None, None, None, F.lit(L.NO_INFORMATION))


def unique_count(df: DataFrame, dimension: str) -> DataFrame:
    counted = df.agg(F.count_distinct(col(dimension)).alias("u"))
    text = _fmt(f"Your dataset has %,d unique values based on {humanize_name(dimension)}.", F.col("u"))
    return _answer(counted, "unique_count", F.lit(dimension), F.col("u"), None, text)


def why_change(df: DataFrame, time: str, measure: str, dimension: str | None) -> DataFrame:
    change = TR.half_period_change(df, time, measure)
    driver = F.lit(None).cast("string")
    if dimension:
        driver = TR.change_driver(df, time, measure, dimension).select("driver").scalar()
    named = change.withColumn("driver", driver)
    size = F.abs("change_percent").cast("string")
    text = F.concat(
        F.lit(f"{humanize_name(measure)} "), F.col("direction"), F.lit(" by "), size,
        F.lit("% between the earlier and later periods."),
        F.coalesce(F.concat(F.lit(" The biggest segment driver was '"), F.col("driver"), F.lit("'.")), F.lit("")),
    )
    return _answer(named, "why_change", F.col("driver"), F.col("change_percent"), None, text)


def weakest(df: DataFrame, dimension: str, measure: str | None) -> DataFrame:
    found = G.bottom_group(df, dimension, measure)
    text = _fmt(f"The weakest {_plain(dimension)} is '%s' with %.2f, only %.1f%% of the total.", F.col("label"), F.col("amount"), F.col("share"))
    return _answer(found, "weakest", F.col("label"), F.col("amount"), F.col("share"), text)


def top_n(df: DataFrame, dimension: str, measure: str, n: int) -> DataFrame:
    found = G.top_n(df, dimension, measure, max(1, min(25, n)))
    text = _fmt("%d. %s: %.2f (%.1f%% of the top total)", F.col("rank"), F.col("label"), F.col("amount"), F.col("share"))
    return _answer(found, "top_n", F.col("label"), F.col("amount"), F.col("share"), text)


def _top_records(df: DataFrame, dimension: str, n: int) -> DataFrame:
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    best = B.frequency(df, [dimension]).orderBy(F.desc("records"), F.asc("value")).limit(n)
    return best.withColumn("share", percent(F.col("records"), rows, 1))


def top_count(df: DataFrame, dimension: str, n: int, kind: str = "top_count") -> DataFrame:
    found = _top_records(df, dimension, n)
    text = _fmt("%s: %d rows (%.1f%%)", F.col("value"), F.col("records"), F.col("share"))
    return _answer(found, kind, F.col("value"), F.col("records"), F.col("share"), text)


def _best_group(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    return G.group_sum_rank(df, dimension, measure).limit(1).withColumn("share", F.round("share", 1))


def leader(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    text = _fmt(
        f"The leading {humanize_name(dimension)} by total {humanize_name(measure)} is '%s'. It contributes %.2f, "
        "representing %.1f%% of the measured total.", F.col("label"), F.col("amount"), F.col("share"),
    )
    return _answer(_best_group(df, dimension, measure), "leader", F.col("label"), F.col("amount"), F.col("share"), text)


def advice(df: DataFrame, dimension: str | None, measure: str | None) -> DataFrame:
    if not dimension:
        return _unknown(df)
    if not measure:
        return top_count(df, dimension, 1, "advice")
    text = _fmt(
        f"Suggestion: focus first on '%s' in {humanize_name(dimension)} because it contributes %.2f, about %.1f%% of "
        f"the measured {humanize_name(measure)}.", F.col("label"), F.col("amount"), F.col("share"),
    )
    return _answer(_best_group(df, dimension, measure), "advice", F.col("label"), F.col("amount"), F.col("share"), text)


def highest_value(df: DataFrame, measure: str) -> DataFrame:
    found = df.agg(F.max(col(measure)).cast("double").alias("v"))
    text = _fmt(f"The highest value is %.2f in {humanize_name(measure)}.", F.col("v"))
    return _answer(found, "highest_value", F.lit(measure), F.col("v"), None, text)


def average(df: DataFrame, measure: str) -> DataFrame:
    found = G.mean_vs_median(df, measure)
    text = _fmt(
        f"The average value for {humanize_name(measure)} is %.2f, while the median is %.2f.", F.col("mean"), F.col("median")
    )
    return _answer(found, "average", F.lit(measure), F.col("mean"), F.col("median"), text)


def outliers(df: DataFrame, measure: str) -> DataFrame:
    found = P.outlier_counts(df, [measure]).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shared = found.withColumn("share", percent(F.col("n"), rows, 1))
    text = F.when(F.col("n") > 0, _fmt(f"Found %d outliers in {humanize_name(measure)} (%.1f%% of rows).", F.col("n"), F.col("share")))
    text = text.otherwise(F.lit(f"No significant outliers detected in {humanize_name(measure)}."))
    return _answer(shared, "outliers", F.lit(measure), F.col("n"), F.col("share"), text)


def row_counts(df: DataFrame) -> DataFrame:
    text = _fmt(
        f"Your dataset contains %d rows and {len(df.columns)} columns. It includes {len(numeric_columns(df))} numeric "
        f"fields, {len(text_columns(df))} categorical fields, and {len(time_columns(df))} date/time fields.", F.col("rows"),
    )
    return _answer(P.shape(df), "rows", None, F.col("rows"), None, text)


def column_counts(df: DataFrame) -> DataFrame:
    n = len(df.columns)
    text = f"Your dataset has {n} columns, including {len(numeric_columns(df))} numeric and {len(text_columns(df))} categorical fields."
    return _answer(df.sparkSession.range(1), "columns", None, F.lit(float(n)), None, F.lit(text))


def quality(df: DataFrame) -> DataFrame:
    missing = P.missing_summary(df).select(F.col("missing_percentage").alias("m"))
    facts = missing.withColumn("d", B.duplicate_stats(df).select("duplicate_rows").scalar())
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shared = facts.withColumn("share", percent(F.col("d"), rows, 1))
    label = F.when((F.col("m") < 5) & (F.col("d") == 0), "healthy").otherwise("needs attention")
    text = _fmt(
        "Data quality looks %s: %.1f%% of cells are missing and there are %d duplicate rows (%.1f%% duplication).",
        label, F.col("m"), F.col("d"), F.col("share"),
    )
    return _answer(shared, "quality", label, F.round("m", 1), F.col("share"), text)


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean and range of a number; distinct count and top three of a text column."""
    if column in numeric_columns(df):
        s = B.numeric_stats(df, [column])
        text = _fmt(f"{column} has %d values, mean %.2f, min %.2f, max %.2f.", F.col("n"), F.col("mean"), F.col("min"), F.col("max"))
        return _answer(s, "describe", F.lit(column), F.round("mean", 2), None, text)
    best = B.top_values(df, [column], 3).groupBy("column", "unique_count").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ", ").alias("top")
    )
    text = _fmt(f"{column} has %d unique values, top examples are %s.", F.col("unique_count"), F.col("top"))
    return _answer(best, "describe", F.lit(column), F.col("unique_count"), None, text)


def answer_plan(df: DataFrame, intent: str, dimension: str | None, measure: str | None, n: int = 1) -> DataFrame:
    """The aggregation that answers one plan."""
    builders = {
        "unique_count": lambda: unique_count(df, dimension),
        "why_change": lambda: why_change(df, Router(df).times[0], measure, dimension),
        "weakest": lambda: weakest(df, dimension, measure),
        "top_n": lambda: top_n(df, dimension, measure, n),
        "top_count": lambda: top_count(df, dimension, n),
        "leader": lambda: leader(df, dimension, measure),
        "highest_value": lambda: highest_value(df, measure),
        "average": lambda: average(df, measure),
        "most_common": lambda: top_count(df, dimension, 1, "most_common"),
        "outliers": lambda: outliers(df, measure),
        "rows": lambda: row_counts(df),
        "columns": lambda: column_counts(df),
        "quality": lambda: quality(df),
        "advice": lambda: advice(df, dimension, measure),
    }
    needs_dimension = {"weakest", "top_count", "leader", "most_common", "top_n"}
    needs_measure = {"highest_value", "average", "outliers", "leader", "top_n"}
    lacking = (intent in needs_dimension and not dimension) or (intent in needs_measure and not measure)
    return _unknown(df) if intent not in builders or lacking else builders[intent]()


def ask(df: DataFrame, question: str) -> DataFrame:
    """Answer one question about one table."""
    asked = df.sparkSession.createDataFrame([(question,)], "question string")
    plan = plan_questions(df, asked).first()
    return answer_plan(df, plan["intent"], plan["dimension"], plan["measure"], plan["n"])


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, with the same columns and types; as it is where Parquet cannot hold it."""
    voids = [c for c, kind in df.dtypes if kind == "void"]
    strange = any(kind == "interval" or "void" in kind and kind != "void" for _, kind in df.dtypes)
    if strange or not df.columns or len({c.lower() for c in df.columns}) < len(df.columns):
        return df
    return staged_table(df).withColumns({c: F.lit(None) for c in voids})


def ask_many(df: DataFrame, questions: DataFrame) -> DataFrame:
    """Answer a table of questions: all distinct plans are computed together from shared aggregations and joined back.

    The table is written once, so what it is made from (joins, and the join sides that the driver builds and holds for them) is needed
    once and not for every aggregation. Answers are at most 25 rows a plan; they are broadcast up to 100 000 rows and joined by shuffle beyond that.
    """
    planned = plan_questions(df, questions)
    times = Router(df).times
    df = _written(df)
    whole = {k: partial(answer_plan, df, k, None, None) for k in ("rows", "columns", "quality", "unknown")}
    answers = answer_plans(df, planned, times[0] if times else None, whole)
    if answers.count() <= 100_000:
        answers = F.broadcast(answers)
    renamed = answers.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    return planned.join(renamed, same).select(*questions.columns, "intent", *ANSWER)


def conversation_context(
    turns: DataFrame, max_words: int = 3, keep: int = 8, slice_turns: int = 256
) -> DataFrame:
    """(conv_id, turn, normalized, engine_question, back): short follow-ups get the question they follow.

    ``turns``: conv_id, turn, text. A question of at most ``max_words`` words is put
    behind the previous question as the engine saw it, so follow-ups chain. Summary and
    'why' questions leave no context. ``back`` is 1 for the last turn; context
    older than ``keep`` turns is forgotten.
    """
    q = normalize_spoken(F.col("text"))
    base = turns.select("conv_id", "turn", q.alias("normalized"))
    n = F.col("normalized")
    summary = contains_any(n, ["explain kpi", "kpi", "business summary", "summary", "health", "important metric"])
    why = F.contains(n, F.lit("why")) & contains_any(n, ["profit", "sales", "revenue"])
    kind = F.when(summary | why, "special").when(F.size(F.split(n, r"\s+")) > max_words, "long").otherwise("short")
    typed = base.withColumn("kind", kind)
    piece = F.floor(F.col("turn") / F.lit(slice_turns))
    seen = bucketed_previous(typed, ["kind"], ["turn"], piece, ["conv_id"])
    starts = (F.col("kind") != "short") | F.col("prev_kind").isNull() | (F.col("prev_kind") == "special")
    anchored = bucketed_running_max(
        seen.withColumn("_start", F.when(starts, F.col("turn"))), "_start", ["turn"], piece, ["conv_id"], "anchor"
    )
    chain = W.partitionBy("conv_id", "anchor").orderBy("turn").rowsBetween(-(keep - 1), W.currentRow)
    joined = F.array_join(F.collect_list("normalized").over(chain), " ")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    return anchored.withColumn("engine_question", F.when(F.col("kind") != "special", joined)).join(last, "conv_id").select(
        "conv_id", "turn", "normalized", "kind", "engine_question",
        (F.col("_last") - F.col("turn") < keep).alias("remembered"),
    )


def explain_kpis(df: DataFrame) -> DataFrame:
    """One text: size, total, strongest city and product, quality."""
    numbers, texts = numeric_columns(df), text_columns(df)
    money = first_match(numbers, ["revenue", "sales", "amount", "total", "price", "profit"])
    city = first_match(texts, ["city", "region", "state"])
    product = first_match(texts, ["product", "item", "name", "category"])
    facts = P.shape(df)
    parts = [_fmt(f"Your dataset has %,d records across {len(df.columns)} columns.", F.col("rows"))]
    if money:
        total = df.agg(F.coalesce(F.sum(col(money)), F.lit(0)).cast("double").alias("t")).scalar()
        facts = facts.withColumn("total", total)
        label = humanize_name(money)
        prefix = "" if label.lower().startswith("total") else "Total "
        parts.append(F.concat(F.lit(f"{prefix}{label} is about "), format_value(F.col("total")), F.lit(".")))
    if money and city:
        best = G.group_sum_rank(df, city, money).limit(1).select(F.struct("label", F.round("share", 1).alias("share")).alias("b"))
        facts = facts.withColumn("city", best.scalar())
        parts.append(_fmt(f"%s is your strongest {humanize_name(city)}, contributing nearly %.1f%% of measured value.", F.col("city.label"), F.col("city.share")))
    if money and product:
        facts = facts.withColumn("product", G.group_sum_rank(df, product, money).limit(1).select("label").scalar())
        parts.append(_fmt(f"Your leading {humanize_name(product)} is %s.", F.col("product")))
    facts = facts.withColumn("missing", P.missing_summary(df).select("missing_cells").scalar())
    facts = facts.withColumn("repeats", B.duplicate_stats(df).select("duplicate_rows").scalar())
    parts.append(
        F.when((F.col("missing") > 0) | (F.col("repeats") > 0), _fmt(
            "Data quality needs attention: %d missing values and %d duplicate rows can affect decisions.", F.col("missing"), F.col("repeats")
        )).otherwise("Data quality looks strong, with no obvious missing-value or duplicate-row blocker.")
    )
    return facts.select(F.concat_ws(" ", *parts).alias("text"))


def suggestions(df: DataFrame, limit: int = 4) -> DataFrame:
    """(rank, text): follow-up questions that the columns can answer."""
    numbers, texts = numeric_columns(df), text_columns(df)
    product = first_match(texts, ["product", "item", "name", "category"])
    city = first_match(texts, ["city", "region", "state", "market"])
    money = first_match(numbers, ["revenue", "sales", "amount", "total", "price", "profit"])
    dated = any("date" in c.lower() for c in df.columns)
    missing = P.missing_summary(df).select((F.col("missing_cells") > 0).alias("m"))
    offers = [
        (F.lit(True), "Ask: Explain my KPIs"),
        (F.lit(bool(product and money)), f"Ask: Which {humanize_name(product or '')} generates maximum revenue?"),
        (F.lit(bool(city and money)), f"Ask: Which {humanize_name(city or '')} is performing best?"),
        (F.lit(dated), "Ask: Why are profits decreasing?"),
        (F.col("m"), "Ask: What should I clean first?"),
    ]
    rules = F.array(*[F.struct(on.alias("on"), F.lit(text).alias("text")) for on, text in offers])
    kept = missing.select(F.posexplode(F.slice(F.filter(rules, lambda r: r["on"]), 1, limit)))
    return kept.select((F.col("pos") + 1).alias("rank"), F.col("col.text").alias("text"))
