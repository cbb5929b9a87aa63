"""Mixing sources to target weights: iterative proportional fitting rakes token weights to source, language and topic
marginals; documents are then sampled by the calibrated probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut, table, unused

MARGINS = ("source", "lang", "topic")
#: Up to so many cells (source x language x topic) are fitted on the driver; more are fitted as a table.
DRIVER_CELLS = 50_000
#: Of the tokens at hand, the share that the sample aims at.
KEEP = 0.7
#: Default targets are a margin's own shares to this power, scaled to sum to one: rare values gain, common ones lose.
TEMPER = 0.7
ROUNDS, TOLERANCE = 200, 1e-9


_WHITE = [" ", "\t", "\n", "\x0b", "\f", "\r"]


def token_count(text: str) -> Column:
    """Words between white space; null and empty texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    edges = F.substring(t, 1, 1).isin(_WHITE).cast("int") + F.substring(t, -1, 1).isin(_WHITE).cast("int")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+", -1)) - edges).cast("long")


def default_topic(text: str) -> Column:
    """What kind of page a text is, by its form: tabular, numeric, marked, list, short or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda kind: F.regexp_count(t, F.lit(kind)) / n
    formed = F.when(share(r"[|\t]") > 0.02, "tabular").when(share(r"[#$%&*<>{}=]") > 0.05, "marked").when(share("[0-9]") > 0.1, "numeric").when(share(r"\n") > 0.02, "list")
    return formed.when(n < 400, "short").otherwise("prose")


def _targets(cells: DataFrame, given: dict[str, dict[str, float]] | None) -> dict[str, DataFrame]:
    """Tables (value, share) by margin; what is not given is the margin's own shares, tempered."""
    out = {}
    for m in MARGINS:
        if given and m in given:
            shares = _as_table(cells.sparkSession, given[m])
        else:
            own = cells.groupBy(m).agg(F.sum("tokens").alias("t")).where("t > 0")
            shares = own.select(F.col(m).alias("value"), F.pow(F.col("t").cast("double"), F.lit(TEMPER)).alias("share"))
        total = shares.agg(F.sum("share")).first()[0]
        out[m] = shares.withColumn("share", F.col("share") / F.lit(total)) if total else shares
    return out


def _as_table(spark, shares: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in shares.items()], "value string, share double")


def rake(cells: list[tuple], targets: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fitted token mass of cells (source, lang, topic, tokens), summing to one: the cells' own mass times a factor per
    margin value such that each margin has its target shares. Values without a target keep no mass; targets without any
    tokens are left out and the others scaled up."""
    mass = np.array([float(c[3]) for c in cells])
    if not mass.sum():
        return mass
    mass /= mass.sum()
    codes, wanted = [], []
    for k, m in enumerate(MARGINS):
        values = sorted({c[k] for c in cells})
        at = {v: i for i, v in enumerate(values)}
        codes.append(np.array([at[c[k]] for c in cells]))
        wanted.append(np.array([targets[m].get(v, 0.0) for v in values]))
    for _ in range(rounds):
        worst = 0.0
        for code, want in zip(codes, wanted):
            have = np.bincount(code, mass, len(want))
            live = np.where(have > 0, want, 0)
            if not live.sum():
                return mass * 0
            live = live / live.sum()
            worst = max(worst, float(np.abs(have / max(have.sum(), 1e-300) - live).max()))
            mass = mass * (live / np.where(have > 0, have, 1))[code]
        if worst < tolerance:
            break
    return mass


def probabilities(tokens: np.ndarray, mass: np.ndarray, keep: float) -> np.ndarray:
    """Of each cell, the sampling probability min(1, s * mass / tokens), with s such that the expected tokens are ``keep``
    of all, or as many as there are with any mass."""
    ratio = np.where(tokens > 0, mass / np.where(tokens > 0, tokens, 1), 0.0)
    goal = keep * tokens.sum()
    full = np.zeros(len(tokens), bool)
    p = np.zeros(len(tokens))
    for _ in range(len(tokens) + 1):
        rest = (tokens * ratio)[~full].sum()
        if not rest:
            break
        s = max(goal - tokens[full].sum(), 0) / rest
        p = np.where(full, 1.0, np.minimum(1.0, s * ratio))
        over = ~full & (s * ratio > 1)
        if not over.any():
            break
        full |= over
    # a cell without tokens has documents without words only; they go by the mean
    return np.where(tokens > 0, p, keep)


def _fit_as_table(cells: DataFrame, targets: dict[str, dict[str, float] | DataFrame], keep: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE, driver_values: int = DRIVER_CELLS) -> DataFrame:
    """The same fit for more cells than the driver should hold, by the same rule, rounds and exact water-filling. A margin of
    at most ``driver_values`` values has its factors on the driver, counted first; a larger one has them in a table
    (value, f, share), remade and checkpointed a round, of which the driver gets one row of sums."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    one = 1.0 if total else 0.0
    factors, wanted = {}, {}
    for m in MARGINS:
        want = targets[m] if isinstance(targets[m], DataFrame) else _as_table(spark, targets[m])
        values = cut(cells.select(F.col(m).alias("value")).distinct().join(want, "value", "left").select("value", F.lit(one).alias("f"), F.coalesce("share", F.lit(0.0)).alias("share")))
        if values.limit(driver_values + 1).count() <= driver_values:
            rows = values.collect()
            factors[m], wanted[m] = {r.value: r.f for r in rows}, {r.value: r.share for r in rows}
        else:
            factors[m] = values

    def fitted() -> DataFrame:
        at = cells.withColumn("mass", F.col("tokens") / F.lit(total or 1.0))
        for m in MARGINS:
            if m in wanted:
                f = F.broadcast(spark.createDataFrame(list(factors[m].items()), f"{m} string, f double").coalesce(1))
            else:
                f = factors[m].select(F.col("value").alias(m), "f")
            at = at.join(f, m).withColumn("mass", F.col("mass") * F.col("f")).drop("f")
        return at

    def on_driver(m: str) -> tuple[float, float]:
        have = {r[0]: r[1] for r in fitted().groupBy(m).agg(F.sum("mass")).collect()}
        live = {v: wanted[m][v] if x > 0 else 0.0 for v, x in have.items()}
        goal, mass, worst = sum(live.values()), max(sum(have.values()), 1e-300), 0.0
        for v, x in have.items():
            share = live[v] / goal if goal else 0.0
            worst = max(worst, abs(x / mass - share))
            factors[m][v] *= share / x if x > 0 else 0.0
        return goal, worst

    def as_table(m: str) -> tuple[float, float]:
        have = fitted().groupBy(F.col(m).alias("value")).agg(F.sum("mass").alias("have"))
        have = cut(factors[m].join(have, "value").withColumn("live", F.when(F.col("have") > 0, F.col("share")).otherwise(0.0)))
        goal, mass = have.agg(F.sum("live"), F.sum("have")).first()
        share = F.col("live") / F.lit(goal or 1.0)
        worst = have.agg(F.max(F.abs(F.col("have") / F.lit(max(mass or 0.0, 1e-300)) - share))).first()[0]
        factors[m] = have.select("value", (F.col("f") * F.when(F.col("have") > 0, share / F.col("have")).otherwise(0.0)).alias("f"), "share")
        return goal or 0.0, worst or 0.0

    for _ in range(rounds if total else 0):
        worst = 0.0
        for m in MARGINS:
            goal, off = on_driver(m) if m in wanted else as_table(m)
            worst = max(worst, off)
            if not goal:
                break
        if worst < tolerance or not goal:
            break
    at = cut(fitted().withColumn("ratio", F.coalesce(F.try_divide("mass", F.col("tokens")), F.lit(0.0))))
    # cells over one are full and the others scaled up, until no more are over; the scale never falls
    scale, full = 0.0, -1
    while True:
        over = F.col("ratio") * F.lit(scale) > 1
        n, held, rest = at.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("tokens") * F.col("ratio")))).first()
        if n <= full or not rest:
            break
        full, scale = n, max(keep * total - float(held or 0), 0.0) / rest
    p = F.least(F.lit(1.0), F.col("ratio") * F.lit(scale))
    return at.select(*MARGINS, F.when(F.col("tokens") > 0, p).otherwise(F.lit(keep)).alias("probability"), "mass")


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, seed: int) -> dict[str, Column]:
    """What a document's probability is made of."""
    kind = topic if topic is not None else default_topic(text_col)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    of = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col), F.lit(seed))).otherwise(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)))
    return {
        "source": text(F.col(source_col)),
        "lang": text(F.col(lang_col)),
        "topic": text(kind),
        "n_tokens": token_count(text_col),
        "u": F.pmod(of, F.lit(1 << 40)) / F.lit(float(1 << 40)),
    }


def _fitted(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, driver_cells: int) -> tuple[DataFrame, bool]:
    """(cells with probability and weight, whether they are few enough to broadcast)."""
    spark = cells.sparkSession
    cells = cut(cells)
    wanted = _targets(cells, targets)
    few = cells.limit(driver_cells + 1).count() <= driver_cells
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    if few:
        # a margin has no more values than there are cells, and what is not among them has no part in the fit
        at = [tuple(r) for r in cells.orderBy(*MARGINS).collect()]
        tokens = np.array([float(c[3]) for c in at])
        mass = rake(at, {m: {r.value: r.share for r in w.join(cells.select(F.col(m).alias("value")).distinct(), "value").collect()} for m, w in wanted.items()})
        rows = [(*c, float(a), float(b)) for c, a, b in zip(at, probabilities(tokens, mass, keep), mass)]
        fitted = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, probability double, mass double")
    else:
        fitted = cut(_fit_as_table(cells, wanted, keep).join(cells, list(MARGINS)))
    weight = F.coalesce(F.try_divide("mass", F.col("tokens") / F.lit(total)), F.lit(0.0))
    return fitted.select(*MARGINS, "probability", weight.alias("weight")), few


def calibrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 17, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight (its cell's fitted share over its own share of
    the tokens), probability, u (a uniform number by hash of the id and the seed), sampled (u < probability).

    A null source, language or topic is the value "" of its margin. Documents without words count as none and are sampled
    by ``keep`` if no document of their cell has any. Rows of the same id share their u, so they are all sampled or none
    if they are of one cell; a null id is hashed by its text. An empty table gives an empty result. A text of any length is
    one row, counted in the JVM. Other columns are not read, whatever their names. Only the table of cells, with a row per source, language and topic, is summed; it is
    fitted on the driver if it has at most ``driver_cells`` rows and as a table otherwise, and joined back by value.
    """
    made = _prepared(docs, id_col, text_col, source_col, lang_col, topic, seed)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), *[v.alias(k) for k, v in made.items()]))
    fitted, few = _fitted(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), targets, keep, driver_cells)
    out = rows.join(F.broadcast(fitted) if few else fitted, list(MARGINS))
    return out.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "u", (F.col("u") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 17, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The sampled documents, with all their columns, whatever the names of others: those that ``calibrated`` marks, null ids
    too; odd inputs as there. Texts are not shuffled if the cells are few."""
    made = _prepared(docs, id_col, text_col, source_col, lang_col, topic, seed)
    cells = docs.select(*[v.alias(k) for k, v in made.items()]).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    fitted, few = _fitted(cells, targets, keep, driver_cells)
    cell, p, u = (unused(docs, x) for x in ("cell", "p", "u"))
    found = fitted.select(F.struct(*MARGINS).alias(cell), F.col("probability").alias(p))
    at = docs.select("*", F.struct(*[made[m].alias(m) for m in MARGINS]).alias(cell), made["u"].alias(u))
    return at.join(F.broadcast(found) if few else found, cell).where(F.col(u) < F.col(p)).select(*docs.columns)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return calibrated(table(spark, sf_dir, "documents"))
