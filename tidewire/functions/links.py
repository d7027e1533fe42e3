"""Links of a message: collected from markup, media and text, then cleaned and reduced."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.fixed import DOMAIN_PATTERN, PRIVATE_LINK_TERMS, URL_PATTERN
from tidewire.functions.text import let, strip

MIN_LENGTH = 4


def _no_links() -> Column:
    return F.array().cast("array<string>")


def _long(links: Column) -> Column:
    return F.filter(links, lambda u: F.length(u) > MIN_LENGTH)


def text_urls(text: Column) -> Column:
    """``http(s)`` URLs in a text, longer than four characters."""
    found = F.regexp_extract_all(text, F.lit(f"({URL_PATTERN})"), F.lit(1))
    return F.when(text.contains("://"), _long(found)).otherwise(_no_links())


def text_domains(text: Column) -> Column:
    """Bare domains in a text, in order.

    Most texts are settled by looking for a dot between two letters or digits. Of the others, only the
    runs of domain characters that hold such a dot are searched; a domain never crosses a run.
    """
    run = r"((?<![a-zA-Z0-9.-])[a-zA-Z0-9.-]*?[a-zA-Z0-9]\.[a-zA-Z0-9][a-zA-Z0-9.-]*)"
    runs = F.array_join(F.regexp_extract_all(text, F.lit(run), F.lit(1)), " ")
    found = F.regexp_extract_all(runs, F.lit(f"({DOMAIN_PATTERN})"), F.lit(1))
    return F.when(text.rlike(r"\.(?<=[a-zA-Z0-9]\.)[a-zA-Z0-9]"), _long(found)).otherwise(_no_links())


def add_uncovered_domains(links: Column, domains: Column) -> Column:
    """Append ``https://domain`` for each domain that no collected link contains yet."""
    return F.aggregate(
        F.array_distinct(domains), links,
        lambda acc, d: F.when(F.exists(acc, lambda u: u.contains(d)), acc)
        .otherwise(F.array_append(acc, F.concat(F.lit("https://"), d))),
    )


def entity_links(text: Column, entities: Column) -> Column:
    """URL entities are cut out of the text by offset and length; the others carry their URL."""
    def one(e: Column) -> Column:
        cut = F.substr(text, e["offset"] + 1, e["length"])
        return strip(F.when(e["type"] == "url", F.when(F.length(cut) > MIN_LENGTH, cut)).otherwise(e["url"]))

    return F.coalesce(F.array_compact(F.transform(entities, one)), _no_links())


def webpage_links(media: Column) -> Column:
    page = media["webpage"]
    urls = F.array_compact(F.array(strip(F.nullif(page["url"], F.lit("")))))
    inside = F.coalesce(text_urls(page["description"]), _no_links())
    return F.when(media["kind"] == "webpage", F.concat(urls, inside)).otherwise(_no_links())


def safe_attribute_urls(urls: Column) -> Column:
    """Leave out links that point at private file downloads."""
    private = "|".join(PRIVATE_LINK_TERMS)
    return F.transform(
        F.filter(urls, lambda u: (u != "") & ~F.lower(u).rlike(private)), lambda u: strip(u))


def document_links(media: Column) -> Column:
    safe = F.coalesce(safe_attribute_urls(media["attribute_urls"]), _no_links())
    return F.when(media["kind"] == "document", safe).otherwise(_no_links())


def reduce_links(links: Column) -> Column:
    """Trim trailing punctuation and keep the links that no other link contains, ignoring case.

    The longest link of a family survives; of equal ones the first in text order.
    """
    clean = F.array_distinct(F.transform(_long(links), lambda u: F.regexp_replace(u, r"[.,;!?)]+\z", "")))
    pairs = F.transform(clean, lambda u: F.struct(u.alias("url"), F.lower(u).alias("key")))

    def beaten(a: Column, b: Column) -> Column:
        longer = F.length(b["key"]) > F.length(a["key"])
        same = (b["key"] == a["key"]) & (b["url"] < a["url"])
        return (longer & b["key"].contains(a["key"])) | same

    def survivors(all_: Column) -> Column:
        kept = F.filter(all_, lambda a: ~F.exists(all_, lambda b: beaten(a, b)))
        return F.array_sort(F.transform(kept, lambda p: p["url"]))

    return let(pairs, survivors)


def extract_links(text: Column, entities: Column | None = None, media: Column | None = None) -> Column:
    """All links of a message as sorted text joined with ``, ``; empty when there is none."""
    body = F.coalesce(text, F.lit(""))
    sources = []
    if entities is not None:
        sources.append(entity_links(body, entities))
    if media is not None:
        sources += [F.coalesce(webpage_links(media), _no_links()),
                    F.coalesce(document_links(media), _no_links())]
    collected = F.array_distinct(F.concat(*sources, text_urls(body)))
    return F.array_join(reduce_links(add_uncovered_domains(collected, text_domains(body))), ", ")
