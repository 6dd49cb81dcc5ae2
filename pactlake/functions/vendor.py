"""Vendor and product-domain detection from titles and server URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactlake.functions.text import col
from pactlake.functions.urls import host_of

#: Fixed values: (id, name, domain, markers), in order of precedence.
VENDORS = (
    ("stripe", "Stripe", "payments", ("stripe",)),
    ("adyen", "Adyen", "payments", ("adyen",)),
    ("paypal", "PayPal", "payments", ("paypal",)),
    ("square", "Square", "payments", ("squareup", "square")),
    ("discord", "Discord", "messaging", ("discord",)),
    ("slack", "Slack", "messaging", ("slack",)),
    ("twilio", "Twilio", "messaging", ("twilio",)),
    ("spotify", "Spotify", "music", ("spotify",)),
    ("github", "GitHub", "code", ("github",)),
    ("gitlab", "GitLab", "code", ("gitlab",)),
    ("sentry", "Sentry", "observability", ("sentry",)),
    ("pagerduty", "PagerDuty", "observability", ("pagerduty",)),
    ("datadog", "Datadog", "observability", ("datadog", "datadoghq")),
    ("digitalocean", "DigitalOcean", "infrastructure", ("digitalocean",)),
    ("cloudflare", "Cloudflare", "infrastructure", ("cloudflare",)),
    ("openai", "OpenAI", "ai", ("openai",)),
    ("anthropic", "Anthropic", "ai", ("anthropic",)),
)
#: Words that hint at a product domain, first match wins.
DOMAIN_WORDS = (
    ("payments", "pay|charge|invoice|billing|checkout|balance"),
    ("messaging", "message|chat|sms|channel"),
    ("music", "track|album|playlist|music|audio"),
    ("code", "repo|commit|pull request|issue"),
    ("observability", "incident|alert|monitor|metric|log"),
    ("infrastructure", "droplet|instance|cluster|server|dns"),
    ("ai", "completion|embedding|model|prompt"),
)


def name_from_title(title: Column | str) -> Column:
    """The title without API words and version tokens; the trimmed title where nothing is left."""
    t = col(title)
    s = F.regexp_replace(t, r"(?i)\bopenapi\b|\bapi\b|\brest\b|\bspecification\b|\bspec\b", " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\bv?\d+(\.\d+)*\b", " "), r"\s+", " "))
    return F.when(F.length(s) > 0, s).otherwise(F.trim(t))


def domain_from_text(text: Column | str) -> Column:
    found = F.lit("generic")
    for domain, words in reversed(DOMAIN_WORDS):
        found = F.when(col(text).rlike(words), domain).otherwise(found)
    return found


def detect_vendor(title: Column | str, server_url: Column | str) -> Column:
    """struct(id, name, domain, recognized): a marker in the host wins over one in host and title."""
    host = host_of(server_url)
    hay = F.lower(F.concat_ws(" ", host, col(title)))
    one = lambda v: F.struct(F.lit(v[0]).alias("id"), F.lit(v[1]).alias("name"), F.lit(v[2]).alias("domain"), F.lit(True).alias("recognized"))
    result = F.struct(F.lit("unknown").alias("id"), name_from_title(title).alias("name"), domain_from_text(hay).alias("domain"), F.lit(False).alias("recognized"))
    for where in (hay, host):
        for v in reversed(VENDORS):
            hit = F.lit(False)
            for m in v[3]:
                hit = hit | F.contains(where, F.lit(m))
            result = F.when(hit, one(v)).otherwise(result)
    return result


def looks_like_different_apis(a: Column | str, b: Column | str) -> Column:
    x, y = (F.regexp_replace(F.lower(name_from_title(t)), "[^a-z0-9]", "") for t in (a, b))
    return (F.length(x) > 0) & (F.length(y) > 0) & ~F.contains(x, y) & ~F.contains(y, x)
