"""Hashes, keyed hashes, encryption and dedup keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.text import col_of, normalize_email
from wayfold.functions.web import registrable_domain


def content_hash(text) -> Column:
    return F.sha2(F.encode(col_of(text), "utf-8"), 256)


def url_hash(url) -> Column:
    return content_hash(F.lower(F.trim(col_of(url))))


def keyed_hash(value, key: bytes) -> Column:
    """HMAC-SHA256 of a normalised address as nested ``sha2`` calls.

    The key is a job option.  Only the two padded blocks enter the plan.
    """
    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in block))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in block))
    message = F.encode(F.coalesce(normalize_email(value), F.lit("")), "utf-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def seal(value, key) -> Column:
    """Encrypt with AES-GCM; the nonce makes equal values differ."""
    return F.aes_encrypt(F.encode(col_of(value), "utf-8"), key, F.lit("GCM"))


def unseal(sealed, key) -> Column:
    """Decrypt; null means unavailable (wrong key or damaged value), never empty."""
    return F.try_aes_decrypt(col_of(sealed), key, F.lit("GCM")).cast("string")


def recipient_key(contact_hash, domain, outlet_id) -> Column:
    """What makes two opportunities one recipient: inbox, then domain, then outlet."""
    dom = col_of(domain)
    return F.coalesce(
        F.concat(F.lit("contact:"), col_of(contact_hash)),
        F.when(F.length(dom) > 0, F.concat(F.lit("domain:"), registrable_domain(dom))),
        F.concat(F.lit("outlet:"), col_of(outlet_id).cast("string")))


def coverage_key(artist_id, genre, url) -> Column:
    """One event per (watched artist, URL), or per (genre tag, URL)."""
    by_artist = url_hash(F.concat_ws("|", col_of(artist_id).cast("string"), col_of(url)))
    by_genre = url_hash(F.concat_ws("|", F.lit("trend"), col_of(genre), col_of(url)))
    return F.when(col_of(artist_id).isNotNull(), by_artist).otherwise(by_genre)


def json_text(value) -> Column:
    """A string as JSON text, non-ASCII kept; null becomes ``null``."""
    v = col_of(value)
    escaped = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def payload_hash(recipient, subject, body, links, attachments, cost, sender) -> Column:
    """Digest over the fields whose change voids an approval, in fixed key order."""
    def listed(items) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(
            F.array_sort(F.coalesce(col_of(items), F.array().cast("array<string>"))),
            json_text), ","), F.lit("]"))
    amount = F.format_string("%.2f", F.coalesce(col_of(cost).cast("double"), F.lit(0.0)))
    canonical = F.concat(
        F.lit('{"attachments":'), listed(attachments), F.lit(',"body":'), json_text(body),
        F.lit(',"cost":'), amount, F.lit(',"from_email":'), json_text(sender),
        F.lit(',"links":'), listed(links), F.lit(',"recipient_hash":'), json_text(recipient),
        F.lit(',"subject":'), json_text(subject), F.lit("}"))
    return F.sha2(F.encode(canonical, "utf-8"), 256)
