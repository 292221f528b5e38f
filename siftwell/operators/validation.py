"""Validation of addresses in stages, and the score and status that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions.text import clamp, joined_notes, normalise_address


def with_facts(addresses: DataFrame, address: str = "address", mx: DataFrame | None = None, dns: DataFrame | None = None, smtp: DataFrame | None = None) -> DataFrame:
    """Adds mx_hosts, resolves and smtp_known from mx(email_domain, mx_hosts), dns(email_domain, resolves) and
    smtp(address, smtp_valid). Without a table a fact was not checked, and its column is null."""
    out = addresses.withColumn("email_domain", E.domain_part(normalise_address(F.col(address))))
    out = out.join(mx.select("email_domain", "mx_hosts"), "email_domain", "left") if mx is not None else out.withColumn("mx_hosts", F.lit(None).cast("array<string>"))
    out = out.join(dns.select("email_domain", "resolves"), "email_domain", "left") if dns is not None else out.withColumn("resolves", F.lit(None).cast("boolean"))
    if smtp is None:
        return out.withColumn("smtp_known", F.lit(None).cast("boolean"))
    return out.join(smtp.select(F.col("address").alias(address), F.col("smtp_valid").alias("smtp_known")), address, "left")


def confidence(syntax: Column, domain: Column, mx_checked: bool, mx: Column, smtp: Column, role: Column, disposable: Column) -> Column:
    """50, +10 syntax, +10 domain, +15 mail exchanger, +10 accepted; -15 role; then -20 and -25, not below 0; disposable: 20 at most."""
    score = F.lit(70) - F.when(role, 15).otherwise(0) + F.when(F.coalesce(smtp, F.lit(False)), 10).otherwise(0)
    if mx_checked:
        score = score + F.when(mx, 15).otherwise(0)
        score = F.when(mx, score).otherwise(F.greatest(score - 20, F.lit(0)))
    score = F.when(~F.coalesce(smtp, F.lit(True)), F.greatest(score - 25, F.lit(0))).otherwise(score)
    score = F.when(disposable, F.least(score, F.lit(20))).otherwise(score)
    return F.when(~syntax, 0).when(~domain, 5).otherwise(clamp(score)).cast("int")


def status(syntax: Column, domain: Column, disposable: Column, smtp: Column, mx: Column, score: Column) -> Column:
    return (
        F.when(~syntax | ~domain | disposable | ~F.coalesce(smtp, F.lit(True)), "invalid")
        .when(mx & (score >= 60), "valid")
        .when(score >= 40, "uncertain")
        .otherwise("invalid")
    )


def validate(addresses: DataFrame, address: str = "address", mx: DataFrame | None = None, dns: DataFrame | None = None, smtp: DataFrame | None = None) -> DataFrame:
    """Adds is_valid_syntax, is_valid_domain, mx_valid, smtp_valid, is_disposable, is_role_based, validation_score,
    validation_status and notes.

    An address without valid syntax scores 0 and one without a valid domain 5; no later stage looks at either, so their other flags are
    false. Where mail exchangers are not checked, ``mx_valid`` is true (and adds nothing here). ``smtp_valid`` null: not
    checked; it is asked for only where there is an exchanger. A domain that does not resolve is noted and costs nothing.
    """
    df = with_facts(addresses, address, mx, dns, smtp)
    a = normalise_address(F.col(address))
    df = df.withColumn("is_valid_syntax", E.valid_syntax(a)).withColumn("is_valid_domain", F.col("is_valid_syntax") & E.valid_domain(E.domain_part(a)))
    on = F.col("is_valid_domain")
    df = (
        df.withColumn("mx_valid", on & (F.lit(True) if mx is None else F.coalesce(F.size("mx_hosts") > 0, F.lit(False))))
        .withColumn("smtp_valid", F.when(F.col("mx_valid"), F.col("smtp_known")))
        .withColumn("is_disposable", on & E.is_disposable(E.domain_part(a)))
        .withColumn("is_role_based", on & E.is_role(E.local_part(a)))
    )
    flags = [F.col(c) for c in ("is_valid_syntax", "is_valid_domain", "mx_valid", "smtp_valid", "is_role_based", "is_disposable")]
    df = df.withColumn("validation_score", confidence(flags[0], flags[1], mx is not None, flags[2], flags[3], flags[4], flags[5]))
    df = df.withColumn("validation_status", status(flags[0], flags[1], flags[5], flags[3], flags[2], F.col("validation_score")))
    notes = F.array_compact(
        F.array(
            F.when(~flags[0], "Failed syntax check"),
            F.when(flags[0] & ~on, "Invalid domain format"),
            F.when(on & ~F.coalesce(F.col("resolves"), F.lit(True)), "DNS resolution failed"),
            F.when(on & ~flags[2], "No MX record"),
            F.when(~F.coalesce(flags[3], F.lit(True)), "SMTP rejected"),
            F.when(flags[5], "Disposable email domain"),
            F.when(flags[4], "Role-based address"),
        )
    )
    return df.withColumn("notes", joined_notes(notes)).drop("email_domain", "mx_hosts", "resolves", "smtp_known")
