"""Fetch policy as columns: status classes, retries, challenges, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the longest honoured Retry-After in seconds.
MAX_RETRY_AFTER = 120.0

#: Markers of anti-bot challenges by vendor, in the order they are tried.
CHALLENGES = (
    ("reCAPTCHA", "g-recaptcha"),
    ("reCAPTCHA", "grecaptcha"),
    ("reCAPTCHA", "recaptcha/api.js"),
    ("hCaptcha", "h-captcha"),
    ("hCaptcha", "hcaptcha"),
    ("Cloudflare", "cf-turnstile"),
    ("Cloudflare", "cf-challenge"),
    ("Cloudflare", "cf-browser-verification"),
    ("Cloudflare", "__cf_chl"),
    ("Cloudflare", "just a moment..."),
    ("Cloudflare", "checking your browser before accessing"),
    ("Cloudflare", "attention required! | cloudflare"),
)


def classify_status(status: Column) -> Column:
    """struct(kind, reason): success, transient or permanent, with a generic reason."""
    kind = F.when(status < 400, "success").when((status == 429) | (status >= 500), "transient").otherwise("permanent")
    text = status.cast("string")
    reason = (
        F.when(status < 400, "")
        .when(status == 429, "rate limited (429)")
        .when(status >= 500, F.concat(F.lit("server error ("), text, F.lit(")")))
        .otherwise(F.concat(F.lit("client error ("), text, F.lit(")")))
    )
    return F.when(status.isNotNull(), F.struct(kind.alias("kind"), reason.alias("reason")))


def detect_challenge(html: Column) -> Column:
    """struct(vendor, marker) of the first marker in a page, else null."""
    low = F.lower(html)
    out = F.lit(None)
    for vendor, marker in reversed(CHALLENGES):
        out = F.when(low.contains(marker), F.struct(F.lit(vendor).alias("vendor"), F.lit(marker).alias("marker"))).otherwise(out)
    return out


def retry_after_seconds(raw: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date less ``now``; null if neither."""
    bare = F.trim(raw)
    date = F.try_to_timestamp(F.regexp_replace(bare, r"^[A-Za-z]+, *", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    wait = (F.unix_micros(date) - F.unix_micros(now)) / 1_000_000
    return F.when(bare.rlike(r"(?U)^\d+$"), bare.try_cast("double")).otherwise(F.greatest(wait, F.lit(0.0)))


def retry_wait(attempt: Column, backoff: Column, retry_after: Column, respect: Column) -> Column:
    """Seconds before the next try: an honoured Retry-After, capped, else exponential backoff."""
    return F.when(retry_after.isNotNull() & respect, F.least(retry_after, F.lit(MAX_RETRY_AFTER))).otherwise(backoff * F.pow(F.lit(2.0), attempt - 1))


def crawl_delay(configured: Column, robots: Column, respect: Column) -> Column:
    """Configured delay, else that of robots.txt where it is respected, else 0."""
    return F.coalesce(configured, F.when(respect, robots), F.lit(0.0))


def is_unchanged(status: Column, body: Column, prior_hash: Column) -> Column:
    """A 304, or a body whose hash is the one seen before; an unseen page has changed."""
    return (status == 304) | F.coalesce(F.sha2(body, 256) == prior_hash, F.lit(False))


def conditional_headers(etag: Column, last_modified: Column) -> Column:
    """Headers of a conditional request from what is known of a page."""
    headers = F.create_map(F.lit("If-None-Match"), etag, F.lit("If-Modified-Since"), last_modified)
    return F.map_filter(headers, lambda _, v: v.isNotNull())


def should_escalate(records: Column, blocked: Column, dead: Column, unchanged: Column) -> Column:
    """A target goes to the browser tier only when the plain one came back with nothing at all."""
    return (records == 0) & (blocked == 0) & (dead == 0) & (unchanged == 0)


def stop_reason(killed: Column, states: Column, requests: Column, seconds: Column, max_states=None, max_requests=None, max_seconds=None) -> Column:
    """Why a run must stop, the first that holds, else null."""
    out = F.lit(None).cast("string")
    for value, limit, why in ((seconds, max_seconds, "time budget reached"), (requests, max_requests, "request budget reached"), (states, max_states, "state budget reached")):
        if limit is not None:
            out = F.when(value >= limit, why).otherwise(out)
    return F.when(killed, "stopped by the operator").otherwise(out)
