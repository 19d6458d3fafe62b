"""Text rules as Column -> Column functions, all JVM-side regular expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One replacement; ``replacement`` uses \\1 for a group, as SQL engines with RE2 do."""

    pattern: str
    replacement: str = ""

    def __call__(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.pattern), F.lit(self.replacement.replace("\\1", "$1")))

    def sql(self, text: str) -> str:
        return f"regexp_replace({text}, '{self.pattern.replace(chr(39), chr(39) * 2)}', '{self.replacement}', 'g')"


# The patterns of the cleaning configuration.
NORMALISE = {
    "txt_punct_spacing": Rule(r"\s+([.,!?;:])", r"\1"),
    "txt_copyright_sentence": Rule(r"(?i)copyright © \d{4}.*all rights reserved\.?"),
    "txt_tos_phrase": Rule(r"(?i)terms of service and privacy policy"),
    "txt_space_comma": Rule(r"\s+,", ","),
    "txt_abbr_defs": Rule(r"(?m)^\s*\*\[.+?\]:.*$"),
    "txt_nav_block": Rule(r"(?m)(?:^\S+$\n\n){4,}^\S+$"),
    "txt_back_to_top": Rule(r"(?im)^\s*back to top\s*$"),
}
JUNK = (
    Rule(r"(?i)(skip to (main )?content|jump to navigation)"),
    Rule(r"(?i)(cookie policy|privacy policy|terms of service|terms and conditions)"),
    Rule(r"(?i)(subscribe to (our )?newsletter)"),
    Rule(r"(?i)(follow us on|share on social media)"),
    Rule(r"(?i)(copyright|©)\s*\d{4}"),
    Rule(r"(?i)(all rights reserved)"),
)
# Rules of our own where only the switch is known.
MARKDOWN = {
    "md_link_text": (Rule(r"\[([^\]]+)\]\([^)]+\)", r"\1"),),
    "md_images": (Rule(r"!\[.*?\]\(.*?\)"),),
    "md_urls": (Rule(r"https?://[^\s)]+|www\.[^\s)]+"),),
    "md_junk": JUNK,
    "md_nav_bullets": (Rule(r"(?m)^[ \t]*\*[ \t]+.*$"),),
    "md_whitespace": (Rule(r"[ \t]+", " "), Rule(r" ?\n ?", "\n"), Rule(r"\n{3,}", "\n\n"), Rule(r"^\s+|\s+$")),
}
EMAILS = Rule(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
#: Off unless named; the patterns of the first two are known, the others are ours.
PII = {
    "ip_address": Rule(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_ADDRESS]"),
    "social_security_number": Rule(r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b", "[SSN]"),
    "email": Rule(EMAILS.pattern, "[EMAIL]"),
    "phone": Rule(r"\+\d{1,3} ?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{4}", "[PHONE]"),
    "iban": Rule(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", "[IBAN]"),
    "credit_card": Rule(r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[CREDIT_CARD]"),
    "passport_number": Rule(r"\b[A-Z]\d{8}\b", "[PASSPORT]"),
    "physical_address": Rule(r"\b\d{1,5} [A-Z][a-z]+ (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln)\b", "[ADDRESS]"),
}
PII_ON = ("ip_address", "social_security_number")


def all_rules(boilerplate: bool = True, emails: bool = False, pii: tuple[str, ...] = PII_ON) -> list[Rule]:
    """The whole chain in its order: normalisation, Markdown, then redaction."""
    first = list(NORMALISE.values()) if boilerplate else [NORMALISE["txt_punct_spacing"]]
    rules = first + [r for rs in MARKDOWN.values() for r in rs]
    return rules + ([EMAILS] if emails else []) + [PII[k] for k in pii]


def apply_rules(text: Column, rules) -> Column:
    for rule in rules:
        text = rule(text)
    return text


def rules_sql(text: str, rules) -> str:
    for rule in rules:
        text = rule.sql(text)
    return text


def cpt_cleanup(text: Column) -> Column:
    """Conservative clean-up before continued pre-training: the Markdown block alone."""
    return apply_rules(text, [r for rs in MARKDOWN.values() for r in rs])


def any_of(words, whole_words: bool = False) -> str:
    """A case-insensitive pattern of literal alternatives."""
    body = "|".join("".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in w) for w in words)
    return f"(?i)\\b(?:{body})\\b" if whole_words else f"(?i)(?:{body})"
