"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type and format: digits stay digits, letters stay letters
of their script and case, an address keeps its octets' widths, a card its checksum if it had one, a name the gender of
its honorific.  A surrogate depends on the key, the type and the entity's canonical form (an e-mail address in lower
case, the bare digits of a number, one token of a name), so every mention gets the same one whatever its punctuation: coreference is kept.

A name is introduced by an honorific or a title; each further capitalised mention of one of its tokens in the same document,
before or after, is rewritten too.  Names that no honorific or title introduces in the document stay.

Distinctness is checked over the whole corpus: surrogates that two entities share, or that equal an entity of the
corpus, are drawn again until none is left.  The few entities that needed another draw are the only ones to be looked up
when texts are rewritten: broadcast while at most ``BROADCAST_ROWS``, joined by a digest of the text beyond, with the same
result.

The key is the caller's secret: whoever has it can recompute the surrogate of a guessed entity.

Defined results: a null text stays null, a text without entities is unchanged; all rows and columns are kept, rows with a
null doc_id included; equal texts are rewritten alike; a column n_entities is replaced.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize

BROADCAST_ROWS = 50_000
#: The setting of the session that holds the key of registered queries.
KEY_SETTING = "spark.corpusmill.surrogates.key"
MAX_DRAWS = 50

_MALE = "Mr Herr Herrn Monsieur Señor Don Signor Sir Г-н Господин Κύριος"
_FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Doña Signora Г-жа Госпожа Κυρία"
#: Titles that say nothing of gender.
_TITLE = "Dr Prof Professor Professorin Doctor Doktor Docteur Professeur Dott Rev Д-р Доктор Профессор Δρ Καθηγητής"
_HONORIFIC = dict.fromkeys(_TITLE.split(), "n") | {**dict.fromkeys(_MALE.split(), "m"), **dict.fromkeys(_FEMALE.split(), "f")}
_GIVEN = {
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul Simon Tomas Viktor".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Frida Greta Helena Ines Julia Klara Laura Maria Nora Olivia Paula Rosa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Олег Павел Роман Фёдор".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Инна Клара Лидия Мария Нина Ольга Раиса Софья".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάριος Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Δανάη Ελένη Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ρένα Σοφία".split(),
}
_SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδκλμνπρστφ" for v in "αειο"],
}
_ENDS = {
    "latin": ("ner", "ley", "son", "berg"), "cyrillic": ("ов", "ин"), "cyrillic/f": ("ова", "ина"), "greek": ("ίδης", "όπουλος"), "greek/f": ("ίδου", "οπούλου"),
}

_TITLES = "|".join(sorted(_TITLE.split(), key=len, reverse=True))
_NAME = r"(?:[^\W\d_]|['’-])+"
_ENTITY = re.compile(
    "|".join(
        (
            r"(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)",
            r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>[^\s\"',;]{6,})",
            r"(?P<key>\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_\w{30,}|\bsk-[\w-]{20,})",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
            r"(?P<phone>\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-]))",
            r"(?P<ssn2>\b\d{3}[- ]?\d{2}[- ]?\d{4}\b)",
            r"(?P<passport>\b[A-Z]\d{8}\b)",
            r"(?P<address>\b\d{1,5} [A-Z][a-z]+ (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln)\b)",
            rf"(?P<honorific>\b(?:{'|'.join(sorted(_HONORIFIC, key=len, reverse=True))})\b\.?)(?: (?:{_TITLES}|med|phil|jur|nat)\b\.?)* (?P<name>[^\W\d_a-zà-öø-ÿа-яё]{_NAME}(?: [^\W\d_a-zà-öø-ÿа-яё]{_NAME})?)",
        )
    )
)
_MAYBE = re.compile(rf"[\d@]|(?i:password|passwd|pwd|token|secret|api[_-]?key)|\b(?:{'|'.join(_HONORIFIC)})\b")
_WORD = re.compile(rf"[^\W\d_]{_NAME}|[^\W\d_]")
_PART = re.compile(r"[^\W\d_]+")
_POSSESSIVE = re.compile(r"(?:['’][sS]|['’-])+$")
_BARE = re.compile(r"[^0-9A-Za-z]")


def _script(token: str) -> str:
    for c in token:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def _mentions_of(names: dict[str, str], text: str, at: int, stop: int):
    """Capitalised mentions of the tokens of ``names`` in a stretch without other entities."""
    for m in _WORD.finditer(text, at, stop):
        word = _POSSESSIVE.sub("", m[0])
        found = [(m.start(), word)]
        if word.lower() not in names:
            found = [(m.start() + p.start(), p[0]) for p in _PART.finditer(word)] if word != _PART.match(word)[0] else []
        for start, token in found:
            if token.lower() in names and token[0] != token[0].lower():
                yield start, start + len(token), names[token.lower()], token.lower()


def entities(text: str):
    """(start, stop, kind, canonical form) in order; a name gives one for each of its tokens."""
    if not _MAYBE.search(text):
        return
    found, names = [], {}
    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        start, stop = m.span(kind)
        raw = m[kind]
        if kind == "email":
            found.append((start, stop, kind, raw.lower()))
        elif kind in ("card", "phone", "ssn", "ssn2", "iban"):
            found.append((start, stop, kind.rstrip("2"), _BARE.sub("", raw)))
        elif kind == "ip":
            if all(int(x) < 256 for x in raw.split(".")):
                found.append((start, stop, kind, raw))
        elif kind == "name":
            gender = _HONORIFIC[m["honorific"].rstrip(".")]
            *given, surname = (_POSSESSIVE.sub("", raw) or raw).split(" ")
            for token in given:
                found.append((start, start + len(token), f"given/{gender}", token.lower()))
                start += len(token) + 1
            kind = f"surname/{gender}" if _script(surname) != "latin" else "surname"
            found.append((start, start + len(surname), kind, surname.lower()))
            for _, _, kind, token in found[-1 - len(given) :]:
                # given names come first, and those with a gender before those without
                names[token] = min(names.get(token, kind), kind)
        else:
            found.append((start, stop, kind, raw))
    if not names:
        yield from found
        return
    at = 0
    for start, stop, kind, canonical in found:
        yield from _mentions_of(names, text, at, start)
        if kind.endswith("/n") or kind == "surname" and names.get(canonical, "").startswith("given"):
            kind = names[canonical]
        yield start, stop, kind, canonical
        at = stop
    yield from _mentions_of(names, text, at, len(text))


class _Stream:
    """Keyed pseudo-random numbers."""

    def __init__(self, key: bytes, kind: str, canonical: str, draw: int):
        self.seed, self.block, self.bytes = (key, f"{kind}\0{canonical}\0{draw}".encode("utf-8", "surrogatepass")), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            key, data = self.seed
            self.bytes = hashlib.blake2b(data + self.block.to_bytes(4, "big"), key=key).digest()
            self.block += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return value * n >> 32


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10


def _like(c: str, s: _Stream, hexadecimal: bool = False) -> str:
    if "0" <= c <= "9":
        return str(s.below(10))
    if hexadecimal and c in "abcdef":
        return "abcdef"[s.below(6)]
    for first, n in (("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 17), ("Α", 17)):
        if first <= c < chr(ord(first) + n):
            return chr(ord(first) + s.below(n))
    return c if c in "._+-@ " or not c.isalpha() else "abcdefghijklmnopqrstuvwxyz"[s.below(26)]


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting names; where it is unset, a random one, so surrogates agree within the run only."""
    named = spark.conf.get(KEY_SETTING, None)
    return hashlib.sha256(named.encode()).digest() if named else secrets.token_bytes(32)


def surrogate(kind: str, canonical: str, key: bytes, draw: int = 0) -> str:
    """The canonical form's surrogate: a function of its arguments only."""
    s = _Stream(key, kind.split("/")[0], canonical, draw)
    base, _, gender = kind.partition("/")
    if base == "email":
        local, _, domain = canonical.partition("@")
        host, dot, top = domain.rpartition(".")
        return "".join(_like(c, s) for c in f"{local}@{host}") + dot + top
    if base == "ip":
        low = {1: (1, 9), 2: (10, 90), 3: (100, 155)}
        return ".".join(str(low[len(x)][0] + s.below(low[len(x)][1])) for x in canonical.split("."))
    if base == "phone":
        keep = len(canonical) - 10 if len(canonical) > 10 else 0
        first = str(2 + s.below(8)) if canonical[keep] > "1" else _like(canonical[keep], s)
        return canonical[:keep] + first + "".join(_like(c, s) for c in canonical[keep + 1 :])
    if base == "card":
        out = canonical[0] + "".join(_like(c, s) for c in canonical[1:])
        return out[:-1] + str((int(out[-1]) - _luhn(out)) % 10) if _luhn(canonical) == 0 else out
    if base == "iban":
        return canonical[:2] + "".join(_like(c, s) for c in canonical[2:])
    if base == "key":
        keep = re.match(r"AKIA|gh[pousr]_|sk-", canonical)[0]
        return keep + "".join(_like(c, s) for c in canonical[len(keep) :])
    if base == "address":
        number, name, street = canonical.split(" ")
        return f"{1 + s.below(9)}{''.join(_like(c, s) for c in number[1:])} {''.join(_like(c, s) for c in name)} {street}"
    if base == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-f]+", canonical) is not None
        return "".join(_like(c, s, hexadecimal) for c in canonical)
    script = _script(canonical)
    if base == "given":
        names = _GIVEN[script, gender] if gender != "n" else _GIVEN[script, "m"] + _GIVEN[script, "f"]
        # few names and many people: later draws add a syllable
        extra = "".join(_SYLLABLES[script][s.below(len(_SYLLABLES[script]))] for _ in range(draw + (gender == "n")))
        name = names[s.below(len(names))]
        return (extra + name if gender == "n" else name + extra).lower()  # so that those without a gender differ from the others
    if base == "surname":
        syllables, ends = _SYLLABLES[script], _ENDS[script + "/f" if gender == "f" and script != "latin" else script]
        stem = "".join(syllables[s.below(len(syllables))] for _ in range(3 + draw // 4))
        return stem + ends[s.below(len(ends))]
    return "".join(_like(c, s) for c in canonical)


def render(raw: str, kind: str, value: str) -> str:
    """The surrogate in the format of the mention: its separators, its capitals."""
    base = kind.split("/")[0]
    if base in ("card", "phone", "ssn", "iban"):
        rest = iter(value)
        return "".join(next(rest, "") if re.match(r"[0-9A-Za-z]", c) else c for c in raw)
    if base == "email":
        return "".join(v.upper() if r.isupper() else v for r, v in zip(raw, value))
    if base in ("given", "surname"):
        return value.upper() if raw.isupper() and len(raw) > 1 else value[0].upper() + value[1:]
    return value


def _found(key: bytes):
    def run(batches):
        for pdf in batches:
            seen = {(kind, canonical) for t in pdf["text"] if t for _, _, kind, canonical in entities(t)}
            rows = [(k, c, surrogate(k, c, key)) for k, c in sorted(seen)]
            yield pd.DataFrame(rows, columns=["kind", "canonical", "surrogate"])

    return run


def _redrawn(key: bytes):
    def run(batches):
        for pdf in batches:
            out = [surrogate(k, c, key, int(d)) for k, c, d in zip(pdf["kind"], pdf["canonical"], pdf["draw"])]
            yield pdf[["kind", "canonical", "draw"]].assign(surrogate=out)

    return run


def redrawn(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, draw, surrogate) of the entities whose first surrogate wasn't distinct."""
    first = docs.select("text").where("text is not null").mapInPandas(_found(key), "kind string, canonical string, surrogate string")
    cur = materialize(first.distinct().withColumn("draw", F.lit(0)))
    for _ in range(MAX_DRAWS):
        # an entity keeps its surrogate if it is the first of those that share it and no entity is written so
        holders = cur.groupBy("kind", "surrogate").agg(F.min(F.struct("draw", "canonical")).alias("holder"), F.count("*").alias("n"))
        originals = cur.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
        clash = holders.join(originals, ["kind", "surrogate"], "left").where("n > 1 or real")
        clash = materialize(clash.select("kind", "surrogate", "holder", F.coalesce("real", F.lit(False)).alias("real")))
        if not clash.take(1):
            break
        again = cur.join(clash, ["kind", "surrogate"]).where("real or canonical != holder.canonical")
        again = again.select("kind", "canonical", (F.col("draw") + 1).alias("draw"))
        new = again.mapInPandas(_redrawn(key), "kind string, canonical string, draw int, surrogate string")
        kept = cur.join(again, ["kind", "canonical"], "left_anti")
        cur = materialize(kept.unionByName(new))
    else:
        raise ValueError(f"surrogates still collide after {MAX_DRAWS} draws")
    return cur.where("draw > 0")


def _rewrite(key: bytes, shared, schema_names: list[str], extra_name: str | None):
    def run(batches):
        known = shared.value if shared is not None else {}
        memo: dict[tuple[str, str], str] = {}
        for batch in batches:
            own = batch.column(extra_name).to_pylist() if extra_name else [None] * batch.num_rows
            texts, counts = [], []
            for text, extra in zip(batch.column("text").to_pylist(), own):
                if text is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                extra = dict(extra) if extra is not None else {}
                out, at, n = [], 0, 0
                for start, stop, kind, canonical in entities(text):
                    value = extra.get(f"{kind}\0{canonical}") or known.get((kind, canonical)) or memo.get((kind, canonical))
                    if value is None:
                        if len(memo) > 100_000:
                            memo.clear()
                        value = memo[kind, canonical] = surrogate(kind, canonical, key)
                    out += (text[at:start], render(text[start:stop], kind, value))
                    at, n = stop, n + 1
                texts.append("".join(out) + text[at:] if n else text)
                counts.append(n)
            new = {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema_names], schema_names)

    return run


def _mentions(batches):
    for pdf in batches:
        rows = {(d, k, c) for d, t in zip(pdf["digest"], pdf["text"]) if t for _, _, k, c in entities(t)}
        yield pd.DataFrame(sorted(rows), columns=["digest", "kind", "canonical"])


def pseudonymise(docs: DataFrame, key: bytes, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of ``docs`` with the text rewritten, plus n_entities."""
    if not key:
        raise ValueError("surrogates need a key")
    docs = docs.drop("n_entities")
    again = materialize(redrawn(docs, key))
    n = again.limit(broadcast_rows + 1).count()
    names = [*docs.columns, "n_entities"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_entities long"
    shared, rows, own = None, docs, None
    if 0 < n <= broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canonical"]): r["surrogate"] for r in again.collect()})
    elif n:
        digest, own = free_name(docs, "digest"), free_name(docs, "own")
        texts = docs.where("text is not null").select(F.sha2("text", 256).alias("digest"), "text")
        mentions = texts.mapInPandas(_mentions, "digest string, kind string, canonical string").distinct()
        pair = F.struct(F.concat_ws("\0", "kind", "canonical"), "surrogate")
        found = mentions.join(again, ["kind", "canonical"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(pair)).alias(own))
        # a table of its own, so that the join can split texts with many copies; rows without a text are spread
        found = materialize(found.withColumnRenamed("digest", digest))
        spread = F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))
        rows = docs.withColumn(digest, F.coalesce(F.sha2("text", 256), spread)).join(found, digest, "left").drop(digest)
    return rows.mapInArrow(_rewrite(key, shared, names, own), schema)
