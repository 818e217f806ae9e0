"""Fair value from characteristics, and a model of negotiability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.config import Thresholds
from pricetide.functions.numbers import half_even
from pricetide.operators.ordering import quantiles
from pricetide.session import cut_lineage

TENANT = ("population",)
FLAGS = ("has_pool", "has_ac", "terrace", "elevator", "parking")
INPUTS = ("log_sqm", "rooms", "bathrooms", *FLAGS)


def _inputs() -> dict[str, Column]:
    return {
        "log_sqm": F.ln(F.col("sqm")),
        **{c: F.coalesce(F.col(c).cast("double"), F.col(f"_mid_{c}")) for c in ("rooms", "bathrooms")},
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FLAGS},
    }


def fit_hedonic(
    features: DataFrame, alpha: float = 1.0, cfg: Thresholds = Thresholds(), keys: Sequence[str] = TENANT
) -> tuple[DataFrame, DataFrame]:
    """Ridge of log price on characteristics per tenant: scored features and fit statistics.

    Training reduces to one aggregate of products per tenant with map-side combine; only those
    sums (55 numbers a tenant) reach the solver.
    """
    keys = list(keys)
    pool = features.where(F.col("price").between(*cfg.train_price) & F.col("sqm").between(*cfg.train_sqm))
    measures = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in ("rooms", "bathrooms")]
    )
    long = pool.select(*keys, F.explode(measures).alias("_m")).select(*keys, "_m.*")
    middle = (
        quantiles(long, [*keys, "measure"], "value", {"median": 0.5})
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("measure") == c, F.col("median"))).alias(f"_mid_{c}") for c in ("rooms", "bathrooms")])
    )
    design = pool.join(middle, keys, "left").select(
        *keys, F.lit(1.0).alias("x0"), *[c.alias(f"x{i}") for i, c in enumerate(_inputs().values(), 1)],
        F.ln("price").alias(f"x{len(INPUTS) + 1}"),
    )
    width = len(INPUTS) + 2
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(width) for j in range(i, width)]
    sums = design.dropna().groupBy(*keys).agg(*products)
    fields = ", ".join(f"{k} {dict(sums.dtypes)[k]}" for k in keys)
    fitted = sums.mapInPandas(_solver(keys, width, alpha), f"{fields}, _beta array<double>, r2 double, n_train long")
    ready = features.join(middle, keys, "left").join(fitted.select(*keys, "_beta"), keys, "left")
    fair = F.exp(
        F.element_at("_beta", 1)
        + sum((F.element_at("_beta", i) * c for i, c in enumerate(_inputs().values(), 2)), F.lit(0.0))
    )
    scored = ready.withColumn(
        "hedonic_fair_price", F.when(F.col("sqm").between(*cfg.train_sqm), half_even(fair))
    ).withColumn(
        "hedonic_residual_pct",
        half_even(
            (F.col("price") - F.col("hedonic_fair_price")) / F.nullif(F.col("hedonic_fair_price"), F.lit(0.0)) * 100, 2
        ),
    )
    stats = fitted.select(
        *keys, "r2", "n_train", F.element_at("_beta", 1).alias("intercept"),
        *[F.element_at("_beta", i).alias(f"b_{n}") for i, n in enumerate(INPUTS, 2)],
    )
    return scored.select(*features.columns, "hedonic_fair_price", "hedonic_residual_pct"), stats


def _solver(keys: Sequence[str], width: int, alpha: float):
    """Normal equations of each tenant's product sums; the intercept carries no penalty."""
    keys = list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, sums in batch.iterrows():
                gram = np.zeros((width, width))
                for i in range(width):
                    for j in range(i, width):
                        gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"]
                x, xy, yy, n = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1], gram[0, 0]
                penalty = alpha * np.eye(width - 1)
                penalty[0, 0] = 0.0
                beta = np.linalg.solve(x + penalty, xy)
                missed = yy - 2 * beta @ xy + beta @ x @ beta
                spread = yy - xy[0] ** 2 / n
                rows.append([*[sums[k] for k in keys], beta.tolist(), 1 - missed / spread if spread else 0.0, int(n)])
            yield pd.DataFrame(rows, columns=[*keys, "_beta", "r2", "n_train"])

    return solve


# ------------------------------------------------------------------ negotiability


# fixed values: what the model looks at
MODEL_NUMBERS = (
    "price", "price_first_seen", "sqm", "rooms", "bathrooms", "year_built", "latitude", "longitude", "has_pool",
    "has_ac", "terrace", "elevator", "parking", "similarity_score", "history_rows", "n_price_changes", "n_cuts",
    "n_increases", "history_span_days", "days_online", "days_since_last_seen", "days_since_last_price_change",
    "price_per_sqm", "discount_from_first_seen_pct", "discount_from_history_peak_pct",
    "price_relative_to_anchor_pct", "budget_fit_score", "quality_score",
)
MODEL_CLASSES = (
    "source", "property_type", "operation", "city", "district", "neighborhood", "energy_rating", "floor",
    "orientation",
)


def negotiation_model(
    features: DataFrame,
    alpha: float = 5.0,
    numbers: Sequence[str] = MODEL_NUMBERS,
    classes: Sequence[str] = MODEL_CLASSES,
    target: str = "negotiation_proxy",
    keys: Sequence[str] = TENANT,
) -> DataFrame:
    """Ridge of the negotiation proxy on everything known, scaled to 0-1 per tenant as `negotiation_model_score`.

    Every tenant has its own medians, scales, fit and range. The normal equations are sums: products of
    numbers, sums of numbers per class level, and counts of level pairs that occur together, all taken
    by aggregates that combine before their shuffle. Only these sums of a tenant meet in one task, where
    conjugate gradients solve them without a dense matrix, in the same way however many levels there
    are. The constant column is penalised like the others.
    """
    keys = list(keys)
    # the fit passes over the features several times, so they are computed once
    features = cut_lineage(features)
    numbers = [c for c in numbers if c in features.columns]
    classes = [c for c in classes if c in features.columns]
    scaled = _scaled(features, [*numbers, target], numbers, keys)
    scaled = cut_lineage(
        scaled.withColumn("_x", F.array(F.lit(1.0), *[F.col(f"_n_{c}") for c in numbers], F.col(f"_n_{target}"))).withColumn(
            "_levels",
            F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("missing"))) for c in classes]).cast("array<string>"),
        )
    )
    beta = cut_lineage(_ridge(scaled, len(numbers) + 2, alpha, keys))
    head = beta.where("_level IS NULL").select(*keys, F.col("_beta").alias("_numbers"))
    terms = F.zip_with(F.slice("_x", 1, len(numbers) + 1), F.col("_numbers"), lambda x, b: x * b)
    raw = scaled.join(head, keys, "left").withColumn("_raw", F.aggregate(terms, F.lit(0.0), lambda total, x: total + x))
    levels = beta.where("_level IS NOT NULL").select(*keys, F.col("_level"), F.element_at("_beta", 1).alias("_b"))
    for place in range(len(classes)):
        raw = (
            raw.withColumn("_level", F.element_at("_levels", place + 1))
            .join(levels, [*keys, "_level"], "left")
            .withColumn("_raw", F.col("_raw") + F.coalesce("_b", F.lit(0.0)))
            .drop("_level", "_b")
        )
    raw = cut_lineage(raw.drop("_x", "_numbers", "_levels"))
    ends = raw.groupBy(*keys).agg(F.min("_raw").alias("_low"), F.max("_raw").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    score = F.when(high > low, (F.col("_raw") - low) / (high - low)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_raw")))
    )
    return raw.join(ends, keys).withColumn("negotiation_model_score", score).select(*features.columns, "negotiation_model_score")


def _scaled(df: DataFrame, filled: Sequence[str], numbers: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """`_n_<name>`: missing values as the tenant's median, `numbers` then as z-scores."""
    keys = list(keys)
    measures = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in filled])
    long = df.select(*keys, F.explode(measures).alias("_s")).select(*keys, "_s.*")
    middle = quantiles(long, [*keys, "m"], "v", {"median": 0.5}).groupBy(*keys).agg(
        *[F.max(F.when(F.col("m") == c, F.col("median"))).alias(f"_mid_{c}") for c in filled]
    )
    known = df.join(middle, keys, "left").withColumns(
        {f"_n_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_mid_{c}"), F.lit(0.0)) for c in filled}
    )
    spread = known.groupBy(*keys).agg(
        *[F.avg(f"_n_{c}").alias(f"_avg_{c}") for c in numbers], *[F.stddev_pop(f"_n_{c}").alias(f"_dev_{c}") for c in numbers]
    )
    flat = lambda c: F.when(F.col(f"_dev_{c}") == 0, 1.0).otherwise(F.col(f"_dev_{c}"))
    return known.join(spread, keys).withColumns(
        {f"_n_{c}": (F.col(f"_n_{c}") - F.col(f"_avg_{c}")) / flat(c) for c in numbers}
    )


def _ridge(scaled: DataFrame, width: int, alpha: float, keys: Sequence[str]) -> DataFrame:
    """Coefficients per tenant: one row with those of the numbers, and one for each level."""
    keys = list(keys)
    none = F.lit(None).cast("string")
    at = lambda i: F.element_at("_x", i + 1)
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    products = scaled.groupBy(*keys).agg(*[F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i, j in upper]).select(
        *keys, none.alias("a"), none.alias("b"), F.array(*[F.col(f"p{i}_{j}") for i, j in upper]).alias("sums")
    )
    one = scaled.select(*keys, F.explode("_levels").alias("a"), "_x")
    mixed = one.groupBy(*keys, "a").agg(*[F.sum(at(i)).alias(f"p{i}") for i in range(width)]).select(
        *keys, "a", none.alias("b"), F.array(*[F.col(f"p{i}") for i in range(width)]).alias("sums")
    )
    pairs = F.flatten(
        F.transform("_levels", lambda x, i: F.transform(F.slice("_levels", i + 2, F.size("_levels")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    )
    both = scaled.select(*keys, F.inline(pairs)).groupBy(*keys, "a", "b").agg(F.array(F.count(F.lit(1)).cast("double")).alias("sums"))
    fields = ", ".join(f"{k} {dict(scaled.dtypes)[k]}" for k in keys)
    sums = products.unionByName(mixed).unionByName(both)
    return sums.groupBy(*keys).applyInPandas(_conjugate(keys, width, alpha), f"{fields}, _level string, _beta array<double>")


def _conjugate(keys: Sequence[str], width: int, alpha: float):
    keys = list(keys)

    def solve(sums: pd.DataFrame) -> pd.DataFrame:
        top = sums[sums.a.isna()].iloc[0]
        mixed = sums[sums.a.notna() & sums.b.isna()].sort_values("a")
        both = sums[sums.b.notna()]
        upper = np.triu_indices(width)
        gram = np.zeros((width, width))
        gram[upper] = top.sums
        gram = gram + np.triu(gram, 1).T
        levels = mixed.a.tolist()
        place = {level: i for i, level in enumerate(levels)}
        cross = np.array(mixed.sums.tolist()).reshape(len(levels), width)
        counts, n = cross[:, 0], width - 1
        left = both.a.map(place).to_numpy(dtype=np.int64)
        right = both.b.map(place).to_numpy(dtype=np.int64)
        weight = np.array([v[0] for v in both.sums])

        def times(v: np.ndarray) -> np.ndarray:
            x, y = v[:n], v[n:]
            low = cross[:, :n] @ x + counts * y
            low += np.bincount(left, weight * y[right], len(y)) + np.bincount(right, weight * y[left], len(y))
            return np.concatenate([gram[:n, :n] @ x + cross[:, :n].T @ y, low]) + alpha * v

        goal = np.concatenate([gram[:n, n], cross[:, n]])
        scale = 1 / (np.concatenate([np.diag(gram)[:n], counts]) + alpha)
        beta, rest = np.zeros(len(goal)), goal.copy()
        step = scale * rest
        gain = rest @ step
        for _ in range(20 * len(goal)):
            if np.linalg.norm(rest) <= 1e-12 * np.linalg.norm(goal):
                break
            image = times(step)
            length = gain / (step @ image)
            beta, rest = beta + length * step, rest - length * image
            before, gain = gain, rest @ (scale * rest)
            step = scale * rest + gain / before * step
        else:
            raise ArithmeticError(f"no solution in {20 * len(goal)} steps; residual {np.linalg.norm(rest):.3g}")
        rows = [[*top[keys], None, beta[:n].tolist()]]
        rows += [[*top[keys], level, [b]] for level, b in zip(levels, beta[n:].tolist())]
        return pd.DataFrame(rows, columns=[*keys, "_level", "_beta"])

    return solve
