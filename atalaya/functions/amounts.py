"""Row expressions over amounts, modalities and payment dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DIRECT_AWARD = "Contratación Directa"
PRICE_COMPARISON = "Comparación de Precios"
TRUE_WORDS = ["1", "true", "t", "si", "sí", "yes", "y"]
FALSE_WORDS = ["0", "false", "f", "no", "n"]
UNPAID_MAX, COMPLETE_MIN, COMPLETE_MAX = 0.01, 0.98, 1.02
NO_PAYMENT = "sin_pago_o_sin_cuantia"
PENDING = "pendiente_sin_pago"
PARTIAL = "pago_parcial"
OVERPAID = "sobrepago_senal_revisar"
COMPLETE = "pagado_aproximadamente_completo"
# ----------------------------------------------------------------------------


def cast_boolean(raw: Column) -> Column:
    """Spanish and English truth words, in any case and padding; null otherwise."""
    word = F.lower(F.trim(raw.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def modality_flags(modality: Column) -> dict[str, Column]:
    """Equality flags of the two modalities that are followed, kept apart."""
    return {
        "es_contratacion_directa": modality == DIRECT_AWARD,
        "es_comparacion_precios": modality == PRICE_COMPARISON,
    }


def cap_amount(amount: Column, limit: float) -> Column:
    """Amount limited above; a missing amount stays missing."""
    return F.when(amount > limit, F.lit(float(limit))).otherwise(amount)


def paid_ratio(paid: Column, amount: Column) -> Column:
    """Paid over contract amount; null unless the amount is positive."""
    return F.when(amount > 0, F.try_divide(paid, amount))


def payment_ratio_status(ratio: Column, payments: Column) -> Column:
    """One of five bands of the paid ratio."""
    return (
        F.when((payments == 0) | ratio.isNull(), F.lit(NO_PAYMENT))
        .when(ratio <= UNPAID_MAX, F.lit(PENDING))
        .when(ratio < COMPLETE_MIN, F.lit(PARTIAL))
        .when(ratio > COMPLETE_MAX, F.lit(OVERPAID))
        .otherwise(F.lit(COMPLETE))
    )


def accrual_delay_days(accrued: Column, paid: Column) -> Column:
    """Calendar days from accrual to payment; null when either date is missing."""
    return F.datediff(paid, accrued)


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
