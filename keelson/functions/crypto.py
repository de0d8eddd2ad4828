"""Column expressions and driver helpers for segmented AES-GCM."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the encrypted stream format: header = magic, salt, base IV; each segment is preceded by
# its length; a zero length ends the stream.
MAGIC = "4442424B"
SALT_BYTES = 16
IV_BYTES = 12
HEADER_BYTES = 32
TAG_BYTES = 16
SEGMENT_BYTES = 64 * 1024 * 1024
MAX_SEGMENT_BYTES = 512 * 1024 * 1024
KEY_ROUNDS = 65_536
KEY_BYTES = 32


def derive_key(passphrase: str, salt: bytes, rounds: int = KEY_ROUNDS) -> bytes:
    """The key of one backup: made once on the driver, like its salt."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode("utf-8"), salt, rounds, KEY_BYTES)


def new_salt() -> bytes:
    return os.urandom(SALT_BYTES)


def backup_keys(spark: SparkSession, passphrase: str, salts: dict[str, bytes]) -> DataFrame:
    """(backup_id, salt, key), one row per backup. Keys are rows of a table and never literals, so no plan shows them.

    Every backup has its own salt and so its own key: places of two backups never share a key and IV.
    """
    if len(set(salts.values())) < len(salts):
        raise ValueError("two backups share a salt")
    rows = [(name, bytearray(salt), bytearray(derive_key(passphrase, salt))) for name, salt in salts.items()]
    return spark.createDataFrame(rows, "backup_id string, salt binary, key binary")


def int64_bytes(number: Column | str) -> Column:
    """Eight big-endian bytes of a whole number."""
    value = F.col(number) if isinstance(number, str) else number
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))


def int32_bytes(number: Column | str) -> Column:
    """Four big-endian bytes of a whole number."""
    value = F.col(number) if isinstance(number, str) else number
    return F.unhex(F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def int32_value(data: Column) -> Column:
    """The signed number in four big-endian bytes."""
    unsigned = F.conv(F.hex(data), 16, 10).cast("bigint")
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)


def segment_iv(base_iv: Column | str, index: Column | str) -> Column:
    """Base IV whose last four bytes are XORed with the big-endian segment index; an index they cannot hold is an error."""
    base = F.col(base_iv) if isinstance(base_iv, str) else base_iv
    number = F.col(index) if isinstance(index, str) else index
    tail = F.conv(F.hex(F.substring(base, 9, 4)), 16, 10).cast("bigint")
    index = number.cast("bigint")
    iv = F.concat(F.substring(base, 1, 8), int32_bytes(tail.bitwiseXOR(index)))
    return F.when((index < 0) | (index >= 2**32), F.raise_error(F.lit("segment index out of range")).cast("binary")).otherwise(iv)


def base_iv(part: Column | str) -> Column:
    """Base IV of a part: its number in eight bytes, and zeros for the index. Distinct for every part under one key."""
    return F.concat(int64_bytes(part), F.lit(bytes(4)))


def segment_aad(backup: Column | str, part: Column | str, index: Column | str) -> Column:
    """Text bound to a segment, so that segments cannot be swapped between places."""
    return F.concat_ws("/", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (backup, part, index)])


def encrypt(data: Column | str, key: Column, iv: Column, aad: Column | None = None) -> Column:
    """IV, cipher text and tag."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv, aad)


def encrypt_fresh(data: Column | str, key: Column, aad: Column) -> Column:
    """IV, cipher text and tag under a new random IV: a task that is tried again may hold other bytes and never reuses an IV."""
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def try_decrypt(data: Column | str, key: Column, aad: Column | None = None) -> Column:
    """Plain bytes, or null for a wrong key or changed bytes."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), aad)
