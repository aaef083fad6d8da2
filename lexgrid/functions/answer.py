"""Texts around an answer: context blocks, prompts, disclaimers, fallbacks, event frames."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"
NO_CONTEXT = "(no matching bylaw passages were retrieved)"
#: What is said without a rule, and below every answer, by language.
FALLBACK = {
    "en": "I could not find a specific rule covering this in the indexed zoning bylaws for this municipality. Please contact the local Municipal Planning & Development department directly.",
    "fr": "Je n'ai pas trouvé de règle précise à ce sujet dans les arrêtés de zonage indexés pour cette municipalité. Veuillez communiquer directement avec le service municipal d'urbanisme et d'aménagement.",
}
VERIFIED = {
    "en": "\n\n*Disclaimer: This AI summary is for informational purposes only and reflects bylaw text last verified on {verified_on}. Official verification should always be confirmed with local municipal planning staff.*",
    "fr": "\n\n*Avis : Ce résumé généré par IA est fourni à titre informatif seulement et reflète le texte de l'arrêté vérifié pour la dernière fois le {verified_on}. Toute vérification officielle doit être confirmée auprès du personnel municipal d'urbanisme.*",
}
UNVERIFIED = {
    "en": "\n\n*Disclaimer: This AI summary is for informational purposes only. The indexed bylaw text has NOT yet been verified against the municipality's current consolidation, so it may be out of date. Always confirm with local municipal planning staff before relying on it.*",
    "fr": "\n\n*Avis : Ce résumé généré par IA est fourni à titre informatif seulement. Le texte indexé n'a PAS encore été vérifié par rapport à la codification administrative en vigueur et pourrait être périmé. Confirmez toujours auprès du personnel municipal d'urbanisme avant de vous y fier.*",
}
#: Fixed value: what the model is told; names in braces are filled in.
SYSTEM_PROMPT = """You are the official Civic Zoning & Bylaw Assistant for Canadian municipalities. You are currently answering for {municipality_name}, {province_name}.

Your goal is to provide accurate, accessible answers regarding land use, secondary suites/ADUs, building setbacks, home businesses, and local zoning rules based ONLY on official municipal bylaws provided in the context below.

CONTEXT FROM OFFICIAL BYLAWS:
-----------------------------
{retrieved_chunks}
-----------------------------

STRICT RESPONSE RULES:
1. Rely EXCLUSIVELY on the provided CONTEXT. If the context does not contain sufficient details to answer the user's query, state: "{fallback}"
2. DO NOT make up rules, speculate, or mix bylaws from different municipalities or provinces. Every chunk above is from {municipality_name} only.
3. INLINE CITATIONS ARE MANDATORY: Every requirement, measurement, or rule stated MUST end with an inline citation formatted as: [{municipality_name} - Bylaw Name, Section X.Y]. Copy the CITE AS label shown with each context passage verbatim, including its plain ASCII square brackets [ and ]. Do NOT substitute typographic or full-width brackets such as 【 】, and do not reformat the label.
4. If retrieved chunks conflict with each other (e.g., an amended vs. original clause), surface both and flag the conflict explicitly rather than silently picking one.
5. FORMATTING: Use clear markdown bullet points, bold key terms, and summarize complex legal jargon into plain language.
6. A permitted use and a conditional use are NOT the same thing. A conditional use requires approval and may be refused. Never describe a conditional use as permitted.
7. Answer in {language_name}.
8. MANDATORY DISCLAIMER: Append this disclaimer at the very end of your response, exactly as written:
{disclaimer}"""
LANGUAGE_NAMES = {"en": "English", "fr": "French"}
#: Provinces and territories by code.
PROVINCE_NAMES = {"AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon"}
MOST_LOGGED, CUT_MARK = 20_000, "... [truncated]"


def by_language(texts: dict[str, str], language: Column) -> Column:
    return F.when(language == "fr", F.lit(texts["fr"])).otherwise(F.lit(texts["en"]))


def disclaimer(language: Column, verified_on: Column) -> Column:
    return F.when(verified_on.isNull(), by_language(UNVERIFIED, language)).otherwise(F.replace(by_language(VERIFIED, language), F.lit("{verified_on}"), verified_on.cast("string")))


def has_disclaimer(answer: Column) -> Column:
    return F.contains(answer, F.lit("*Disclaimer:")) | F.contains(answer, F.lit("*Avis :")) | F.contains(answer, F.lit("*Avis:"))


def context(passages: Column) -> Column:
    """Passages (array of struct position, citation, title, page, content, in any order) as one numbered block."""

    def one(p: Column) -> Column:
        title = F.when(p["title"].isNotNull() & (p["title"] != ""), F.concat(F.lit("\nSection title: "), p["title"])).otherwise("")
        page = F.when(F.coalesce(p["page"], F.lit(0)) != 0, F.concat(F.lit("\nPage: "), p["page"].cast("string"))).otherwise("")
        return F.concat(F.lit("[Passage "), p["position"].cast("string"), F.lit("] CITE AS: "), p["citation"], title, page, F.lit("\n"), p["content"])

    return F.when(F.size(passages) == 0, NO_CONTEXT).otherwise(F.array_join(F.transform(F.array_sort(passages), one), SEPARATOR))


def logged(answer: Column) -> Column:
    return F.when(F.length(answer) > MOST_LOGGED, F.concat(F.left(answer, F.lit(MOST_LOGGED)), F.lit(CUT_MARK))).otherwise(answer)


def client_key(ip: Column, session: Column) -> Column:
    """ip, with the first 64 characters of a session that is not blank."""
    return F.concat_ws(":", ip, F.nullif(F.left(F.trim(session), F.lit(64)), F.lit("")))


def frames(body: Column) -> Column:
    """Events of a server-sent body: array of struct event, data; parts that are no JSON object are dropped."""
    parts = F.split(body, r"\r?\n\r?\n")
    field = lambda p, name: F.regexp_extract(p, rf"(?m)^{name}:[ ]?([^\r\n]*)", 1)
    return F.filter(F.transform(parts, lambda p: F.struct(field(p, "event").alias("event"), field(p, "data").alias("data"))), lambda e: e["data"].startswith("{") & F.try_parse_json(e["data"]).isNotNull())


def province_name(code: Column) -> Column:
    """The name of a province, or its code where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PROVINCE_NAMES.items() for x in pair]), code), code)


def system_prompt(municipality: Column, province: Column, language: Column, verified_on: Column, passages: Column) -> Column:
    """What the model is told: the rules, and the passages as ``context`` writes them. Texts are put in once, so braces in them stay."""
    said = {"municipality_name": municipality, "province_name": province_name(province), "retrieved_chunks": context(passages), "fallback": by_language(FALLBACK, language), "language_name": by_language(LANGUAGE_NAMES, language), "disclaimer": F.trim(F.regexp_replace(disclaimer(language, verified_on), r"^\s+|\s+$", ""))}
    parts = re.split(r"\{(\w+)\}", SYSTEM_PROMPT)
    return F.concat(*[said[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def citation_url(metadata: Column, source_url: Column) -> Column:
    """The document that a chunk's own metadata names, else its municipality's."""
    return F.coalesce(F.nullif(F.get_json_object(metadata, "$.url"), F.lit("")), source_url)


def cited(answer: Column) -> Column:
    """Inline citations of an answer: array of struct source, section."""
    found = F.regexp_extract_all(answer, F.lit(r"(\[[^\]]+?, Section [^\]]+?\])"), 1)
    field = lambda x, i: F.regexp_extract(x, r"^\[(.+), Section (.+)\]$", i)
    return F.transform(found, lambda x: F.struct(field(x, 1).alias("source"), field(x, 2).alias("section")))


def answer_blocks(answer: Column) -> Column:
    """An answer as it is shown: array of struct kind (bullet, disclaimer, paragraph), text and spans, blank lines left out.

    Spans are array of struct kind (bold, citation, text), text: the words between two asterisks, the section of a citation.
    """
    lines = F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))

    def spans(text: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(text, r"(\*\*[^*]+\*\*|\[[^\]]+?, Section [^\]]+?\])", "\u0000$1\u0000"), "\u0000"), lambda p: p != "")
        bold, section = (lambda p: F.regexp_extract(p, r"^\*\*([^*]+)\*\*$", 1)), (lambda p: F.regexp_extract(p, r"^\[.+, Section (.+)\]$", 1))
        return F.transform(parts, lambda p: F.when(bold(p) != "", F.struct(F.lit("bold").alias("kind"), bold(p).alias("text"))).when(section(p) != "", F.struct(F.lit("citation").alias("kind"), section(p).alias("text"))).otherwise(F.struct(F.lit("text").alias("kind"), p.alias("text"))))

    def block(line: Column) -> Column:
        bullet = F.regexp_extract(line, r"^\s*[-*•]\s+(.*)$", 1)
        kind = F.when(line.rlike(r"^\s*[-*•]\s+"), "bullet").when(line.startswith("*") & line.endswith("*"), "disclaimer").otherwise("paragraph")
        text = F.when(kind == "bullet", bullet).when(kind == "disclaimer", F.substr(line, F.lit(2), F.length(line) - 2)).otherwise(line)
        return F.struct(kind.alias("kind"), text.alias("text"), F.when(kind != "disclaimer", spans(text)).alias("spans"))

    return F.transform(F.filter(lines, lambda x: F.trim(x) != ""), block)
