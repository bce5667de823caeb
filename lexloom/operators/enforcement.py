"""Privacy enforced around model calls: what may be sent where, redaction before, restoring after."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.privacy import detect, merge_spans, needs_redaction, redact, restore
from lexloom.plans.runtime import materialize
from lexloom.plans.tasks import Provider, complete

#: Networks whose addresses are local.
LOCAL_NETWORKS = tuple(map(ipaddress.ip_network, ("127.0.0.0/8", "::1/128", "0.0.0.0/32", "::/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "100.64.0.0/10", "169.254.0.0/16", "fe80::/10")))


#: Models that a local server passes on: 'cloud' as the end of the last part of a name, before any digest.
_CLOUD_MODEL = re.compile(r"(?i)(?:[^@]*[:/-])?cloud(?:@.*)?")


def is_local_address(text: str) -> bool:
    at = ipaddress.ip_address(text)
    at = getattr(at, "ipv4_mapped", None) or at
    return any(at in n for n in LOCAL_NETWORKS if n.version == at.version)


def addresses_of(host: str | None, resolve: Callable[[str], list[str]] | None) -> list[str]:
    """The addresses behind a host or its URL: itself if it is one, else what ``resolve`` says; none if that is not known."""
    name = urlsplit(host if "://" in host else f"//{host}").hostname if host else None
    if not name:
        return []
    try:
        return [str(ipaddress.ip_address(name))]
    except ValueError:
        pass
    try:
        return list(resolve(name)) if resolve else []
    except OSError:
        return []


def not_local(provider: Provider, resolve: Callable[[str], list[str]] | None = None) -> str | None:
    """Why a provider may not see a document for local models only; None if it may. It must say that it is local, name no cloud model,
    and have a host all of whose addresses are local; names are looked up by ``resolve`` (without it only addresses are known)."""
    at = addresses_of(getattr(provider, "host", None), resolve)
    reasons = {
        f"provider {provider.name} is not local": not getattr(provider, "is_local", False),
        "its model runs in a cloud": bool(_CLOUD_MODEL.fullmatch(getattr(provider, "model", ""))),
        "the addresses of its host are not known": not at,
        "its host is at a public address": not all(map(is_local_address, at)),
    }
    return next((why for why, holds in reasons.items() if holds), None)


def decision(route: Column, sensitivity: Column, done: Column, local_reason: str | None) -> Column:
    """blocked, routing_error (local only, but the provider isn't), sent_redacted or sent_raw. A missing or unknown route is blocked."""
    sent = F.when(needs_redaction(sensitivity, done), "sent_redacted").otherwise("sent_raw")
    return F.when(route == "any", sent).when(route == "local_only", F.lit("routing_error") if local_reason else sent).otherwise("blocked")


def enforced(prompts: DataFrame, provider: Provider, restored: bool = True, resolve: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(id, decision, sent, answer, error) for prompts (id, prompt, route, sensitivity, redaction_done).

    Only prompts that may be sent reach the provider, those that need it without personal data; with ``restored`` the placeholders in
    the answers are replaced by what they stood for. ``sent`` is what the provider saw."""
    decided = prompts.withColumn("decision", decision(F.col("route"), F.col("sensitivity"), F.col("redaction_done"), not_local(provider, resolve)))
    allowed = decided.filter(F.col("decision").startswith("sent"))
    clean = redact(allowed, merge_spans(detect(allowed.filter("decision = 'sent_redacted'"), "id", "prompt")), "id", "prompt").select(F.col("doc").alias("id"), F.col("redacted").alias("prompt"), "mapping")
    said = materialize(complete(clean, provider), "enforced").select("id", F.col("prompt").alias("sent"), (restore(F.col("answer"), F.col("mapping")) if restored else F.col("answer")).alias("answer"), "error")
    return decided.select("id", "decision").join(said, "id", "left")
