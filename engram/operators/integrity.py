"""Checksums, rules that records must meet, sensitivity of texts, and differences between a source and its copy."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of personal data and words of sensitive or regulated text.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "korean_rrn": r"\b\d{6}-[1-4]\d{6}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
}
SENSITIVE_WORDS = ("password", "secret", "token", "key", "api_key", "private", "credential", "auth", "비밀번호", "인증")
MEDICAL_WORDS = ("medical", "health", "patient", "진료", "환자")
FINANCE_WORDS = ("financial", "payment", "account", "금융", "계좌")
#: Length in hex digits and algorithm.
ALGORITHMS = ((32, "md5"), (40, "sha1"), (64, "sha256"), (96, "sha384"), (128, "sha512"))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def sensitivity(df: DataFrame, text: str) -> DataFrame:
    """Add pii (names of patterns found, joined), sensitive, medical, finance and level: pii, confidential or public."""
    t = F.col(text)
    found = F.array_compact(F.array(*(F.when(t.rlike("(?i)" + p), F.lit(name)) for name, p in PII_PATTERNS.items())))
    out = df.withColumns({"pii": F.array_join(found, ","), "sensitive": any_of(t, SENSITIVE_WORDS), "medical": any_of(t, MEDICAL_WORDS), "finance": any_of(t, FINANCE_WORDS)})
    return out.withColumn("level", F.when(F.col("pii") != "", "pii").when(F.col("sensitive"), "confidential").otherwise("public"))


def algorithm_of(checksum: Column) -> Column:
    """The algorithm that makes hex digests of that length; null for none or for what is not hex."""
    out = F.lit(None).cast("string")
    for n, name in ALGORITHMS:
        out = F.when(F.length(checksum) == n, name).otherwise(out)
    return F.when(checksum.rlike("^[0-9a-fA-F]+$"), out)


def manifest(df: DataFrame, key: str, text: str) -> DataFrame:
    """Checksums and size in bytes of each given text."""
    return df.filter(F.col(text).isNotNull()).select(key, F.md5(text).alias("md5"), F.sha1(text).alias("sha1"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).alias("size_bytes"))


def differences(source: DataFrame, target: DataFrame, key: str, text: str) -> DataFrame:
    """One row per key of either side: key, status (match, mismatch, missing, extra). Two null texts match."""
    digest = lambda df, name: df.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias(name), F.lit(True).alias(f"in_{name}"))
    both = digest(source, "s").join(digest(target, "t"), key, "full")
    return both.select(key, F.when(F.col("in_t").isNull(), "missing").when(F.col("in_s").isNull(), "extra").when(F.col("s") == F.col("t"), "match").otherwise("mismatch").alias("status"))


def broken_rules(df: DataFrame, key: str, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """Rows by rule that they break: rule -> (condition that must hold, severity). A condition that is null does not hold."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (ok, severity) in rules.items())))
    return df.select(key, F.explode(failed).alias("r")).select(key, "r.rule", "r.severity")
