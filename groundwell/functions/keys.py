"""Keys, digests, addresses and the text timestamps used by the account tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The address rule.
EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"
EMAIL_MAX = 254


def cache_key(*parts: Column) -> Column:
    """32 hex digits over the parts joined with a bar; the text itself never enters the key."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def embedding_key(model: str, dim: int, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dim)), text), 256)


def subject_digest(subject: Column, fingerprint: str) -> Column:
    """24 hex digits naming a quota subject without storing it."""
    return F.substring(F.sha2(F.concat_ws("|", subject, F.lit(fingerprint)), 256), 1, 24)


def normalise_email(email: Column) -> Column:
    return F.lower(strip(F.coalesce(email, F.lit(""))))


def valid_email(email: Column) -> Column:
    """Whether a normalised address passes the permissive shape check."""
    return (F.length(email) > 0) & (F.length(email) <= EMAIL_MAX) & email.rlike(EMAIL)


def client_address(forwarded: Column, real_ip: Column, peer: Column, trust_proxy: bool = True) -> Column:
    """First hop of the forwarding header where it is trusted, else the peer."""
    fallback = F.coalesce(F.nullif(peer, F.lit("")), F.lit("unknown"))
    if not trust_proxy:
        return fallback
    header = F.coalesce(F.nullif(forwarded, F.lit("")), F.nullif(real_ip, F.lit("")))
    return F.when(header.isNotNull(), strip(F.split_part(header, F.lit(","), F.lit(1)))).otherwise(fallback)


def iso_millis(ts: Column) -> Column:
    """UTC text timestamp with milliseconds; sorts as text in time order."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def epoch_millis(iso: Column) -> Column:
    """Milliseconds since the epoch of a text timestamp; NULL where it cannot be read."""
    return F.unix_millis(F.try_to_timestamp(iso))


def window_index(epoch_seconds: Column, width_s: int) -> Column:
    """Number of the fixed window a second falls in."""
    return F.floor(epoch_seconds / F.lit(width_s))
