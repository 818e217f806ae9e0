"""What a price means for a buyer: cash, payments, limits and ways to reach it.

A buyer is a `BuyerProfile` (constants) or a mapping of column names, so many buyers can be
evaluated against many prices in one pass.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.config import BuyerProfile
from pricetide.functions.loans import loan_for_payment, monthly_payment, required_rate
from pricetide.functions.numbers import half_even

Buyer = BuyerProfile | dict[str, str]
AFFORD_FIELDS = (
    "purchase_costs", "cash_needed_at_ltv", "required_cash_for_feasible", "cash_shortfall", "months_to_feasible",
    "months_to_feasible_no_extras", "ltv_at_feasible_pct", "loan_needed_with_savings", "ltv_needed_with_savings_pct",
    "monthly_payment_needed", "monthly_payment_at_ltv", "effort_rate_pct", "verdict",
)


def buyer_columns(buyer: Buyer) -> dict[str, Column]:
    """Every budget figure as a column; figures a mapping leaves out take the default."""
    values = {k: F.lit(v) for k, v in asdict(buyer if isinstance(buyer, BuyerProfile) else BuyerProfile()).items()}
    if not isinstance(buyer, BuyerProfile):
        values.update({k: F.col(v) for k, v in buyer.items()})
    return values


def _whole(value: Column) -> Column:
    return F.rint(value).cast("long")


def affordability(
    df: DataFrame, price: str, buyer: Buyer = BuyerProfile(), ltv: float | None = None, prefix: str = ""
) -> DataFrame:
    """Add the cash and payment picture of a price, with a graded verdict.

    The loan is capped by the bank's share of the price and by the payment ceiling. A cash gap may
    be closed by extra cash, by months of saving, or not within two years.
    """
    b = buyer_columns(buyer)
    rate, years, savings = b["annual_rate_pct"], b["term_years"], b["savings"]
    share = F.lit(float(ltv)) if ltv is not None else b["max_ltv"]
    p = F.col(price)
    costs = p * (b["itp_rate"] + b["fees_rate"])
    full_loan = p * share
    base = df.withColumns(
        {
            "_costs": costs,
            "_full": full_loan,
            "_allowed": F.least(full_loan, loan_for_payment(b["stretch_payment"], rate, years)),
            "_own": F.greatest(F.lit(0.0), p + costs - savings),
        }
    )
    required = p + F.col("_costs") - F.col("_allowed")
    base = base.withColumn("_required", required).withColumn(
        "_gap", F.greatest(F.lit(0.0), F.col("_required") - savings)
    )
    gap = F.col("_gap")
    after = F.greatest(F.lit(0.0), gap - b["extra_cash_if_needed"])

    def months(amount: Column) -> Column:
        saves = (amount > 0) & (b["monthly_savings"] > 0)
        return F.when(saves, F.ceil(amount / b["monthly_savings"])).otherwise(F.lit(0)).cast("int")

    base = base.withColumns(
        {
            "_months": months(after),
            "_payment": monthly_payment(F.when(gap == 0, F.col("_own")).otherwise(F.col("_allowed")), rate, years),
        }
    )
    payment = F.col("_payment")
    verdict = (
        F.when((gap == 0) & (payment <= b["comfortable_payment"]), "comfortable")
        .when((gap == 0) & (payment <= b["max_payment"]), "ok")
        .when(gap == 0, "stretch")
        .when(gap <= b["extra_cash_if_needed"], "con_extras")
        .when(F.col("_months") <= 24, F.concat(F.lit("en_"), F.col("_months").cast("string"), F.lit("_meses")))
        .otherwise("fuera_de_alcance")
    )
    unknown = p.isNull()
    figures = {
        "purchase_costs": _whole(F.col("_costs")),
        "cash_needed_at_ltv": _whole(p - F.col("_full") + F.col("_costs")),
        "required_cash_for_feasible": _whole(F.col("_required")),
        "cash_shortfall": _whole(gap),
        "months_to_feasible": F.col("_months"),
        "months_to_feasible_no_extras": months(gap),
        "ltv_at_feasible_pct": half_even(F.col("_allowed") / F.nullif(p, F.lit(0)) * 100, 1),
        "loan_needed_with_savings": _whole(F.col("_own")),
        "ltv_needed_with_savings_pct": half_even(F.col("_own") / F.nullif(p, F.lit(0)) * 100, 1),
        "monthly_payment_needed": _whole(payment),
        "monthly_payment_at_ltv": _whole(monthly_payment(F.col("_full"), rate, years)),
        "effort_rate_pct": half_even(payment / b["monthly_net_income"] * 100, 1),
        "verdict": verdict,
    }
    return base.withColumns({prefix + k: F.when(~unknown, v) for k, v in figures.items()}).drop(
        "_costs", "_full", "_allowed", "_own", "_required", "_gap", "_months", "_payment"
    )


def max_price(
    df: DataFrame, buyer: Buyer = BuyerProfile(), payment: float | str | None = None, include_extras: bool = False
) -> DataFrame:
    """The dearest price the payment cap, the savings and the bank's share support."""
    b = buyer_columns(buyer)
    pay = b["max_payment"] if payment is None else b[payment] if isinstance(payment, str) else F.lit(float(payment))
    cash = b["savings"] + (b["extra_cash_if_needed"] if include_extras else F.lit(0.0))
    cap = loan_for_payment(pay, b["annual_rate_pct"], b["term_years"])
    fees = b["itp_rate"] + b["fees_rate"]
    by_payment = (cap + cash) / (1 + fees)
    by_ltv = cash / (1 - b["max_ltv"] + fees)
    by_loan = cap / b["max_ltv"]
    return df.withColumns(
        {
            "payment_used": pay,
            "savings_used": _whole(cash),
            "max_loan": _whole(cap),
            "max_price_by_payment_and_savings": _whole(F.least(by_payment, F.lit(1e7))),
            "max_price_by_ltv_and_savings": _whole(by_ltv),
            "binding_max_price": _whole(F.least(by_payment, by_ltv, by_loan)),
        }
    )


def asking_ceiling(binding: Column, typical_discount: float = 0.06) -> Column:
    """Dearest asking price worth a look when the usual discount is won."""
    return _whole(binding / (1 - typical_discount))


def scenario_grid(df: DataFrame, price: str = "price", buyer: Buyer = BuyerProfile()) -> DataFrame:
    """For each price: figures at 80 % and 90 % loans and the easiest ways to get there."""
    b = buyer_columns(buyer)
    s = affordability(affordability(df, price, buyer, 0.80, "_s_"), price, buyer, 0.90, "_n_")
    # the rate is a bisection, so it is sought only where the payment is too dear
    too_dear = F.col("_s_monthly_payment_at_ltv") > b["stretch_payment"]
    s = max_price(s, buyer, "stretch_payment", include_extras=True).withColumn(
        "_rate", F.when(too_dear, required_rate(F.col(price) * 0.80, b["stretch_payment"], b["term_years"]))
    )
    gap, months = F.col("_s_cash_shortfall"), F.col("_s_months_to_feasible_no_extras")
    pay80, pay90 = F.col("_s_monthly_payment_at_ltv"), F.col("_n_monthly_payment_at_ltv")
    cash, stretch = b["savings"], b["stretch_payment"]
    bound = pay80 > stretch

    def dotted(value: Column) -> Column:
        return F.translate(F.format_number(F.rint(value), 0), ",", ".")

    def thousands(value: Column) -> Column:
        return F.concat(_whole(value / 1000).cast("string"), F.lit("k"))

    # fixed values: wording of the ways
    ways = F.array(
        F.when((gap <= b["extra_cash_if_needed"]) & ~bound, F.concat(F.lit("usar extras (faltan "), thousands(gap), F.lit(")"))),
        F.when(
            (pay90 <= stretch) & (F.col("_n_cash_needed_at_ltv") <= cash),
            F.concat(F.lit("hipoteca 90% (cash ok. cuota "), dotted(pay90), F.lit(" €)")),
        ).when(
            (pay90 <= stretch) & (F.col("_n_cash_needed_at_ltv") <= cash + b["extra_cash_if_needed"]),
            F.concat(F.lit("hipoteca 90% + extras (cuota "), dotted(pay90), F.lit(" €)")),
        ),
        F.when(
            (months > 0) & bound,
            F.concat(
                F.lit("ahorrar "), F.col("_s_months_to_feasible").cast("string"),
                F.lit(" meses con extras (baja el LTV a "), _whole(F.col("_s_ltv_at_feasible_pct")).cast("string"),
                F.lit("% para mantener cuota ≤ "), dotted(stretch), F.lit(" €)"),
            ),
        ).when(months > 0, F.concat(F.lit("ahorrar "), months.cast("string"), F.lit(" meses (sin extras)"))),
        F.when(
            bound & (F.col("_rate") > 0) & (F.col("_rate") < b["annual_rate_pct"]),
            F.concat(
                F.lit("tipo ≤ "), F.format_string("%.2f", F.col("_rate")), F.lit("% (hoy asumes "),
                b["annual_rate_pct"].cast("string"), F.lit("%)"),
            ),
        ),
    )
    found = F.filter(ways, lambda w: w.isNotNull())
    haggle = F.concat(F.lit("negociar el precio a ≤ "), thousands(F.col("binding_max_price")))
    listed = F.when(
        (F.size(found) == 0) | (F.col("_s_months_to_feasible") > 24), F.concat(found, F.array(haggle))
    ).otherwise(found)
    due = F.col("_s_monthly_payment_needed")
    path = (
        F.when((gap == 0) & (due <= b["max_payment"]), "✅ entra ya (80% LTV, solo ahorros)")
        .when((gap == 0) & (due <= stretch), "✅ entra ya al 80%, pero con cuota exigente")
        .otherwise(F.array_join(F.slice(listed, 1, 3), " · o "))
    )
    return s.select(
        *df.columns,
        F.col("_s_cash_needed_at_ltv").alias("cash_80"),
        pay80.alias("payment_80"),
        F.col("_n_cash_needed_at_ltv").alias("cash_90"),
        pay90.alias("payment_90"),
        months.alias("months_no_extras"),
        path.alias("path"),
        F.col("_s_verdict").alias("verdict"),
    )
