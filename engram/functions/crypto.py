"""Texts encrypted with AES-256-GCM under the digest of a master key. The initial vector is random, so equal texts differ."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(master: str) -> Column:
    return F.unhex(F.sha2(F.lit(master), 256))


def encrypt(text: Column, master: str) -> Column:
    return F.base64(F.aes_encrypt(text, _key(master), F.lit("GCM")))


def decrypt(text: Column, master: str) -> Column:
    """The plain text, or null where the text was not made under this key."""
    return F.try_aes_decrypt(F.unbase64(text), _key(master), F.lit("GCM")).cast("string")
