"""Personal data: patterns propose, checksums confirm, words nearby move the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwatch.llm.tables import per_batch, texts_of

#: kinds in the order in which spans are listed; the first four are always found, the others need their score
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national_phone")
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# runs of digits are taken whole, which a greedy match does anyway, so that long runs cost no second look
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_REST_OF = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(15, 35)}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+(])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])")

#: characters of an IBAN by country (ISO 13616 registry)
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}

#: score before context, after the checksum
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "national_phone": 0.3}
#: words (lower case, English, German, French, Spanish) within ``NEARBY`` characters before or after a span that speak for it
_CALL = ("phone", "phones", "telephone", "call", "calls", "tel", "mobile", "cell", "fax", "telefon", "handy", "anruf", "anrufen", "mobil", "rufnummer",
         "téléphone", "téléphoner", "appel", "appeler", "appelez", "portable", "teléfono", "móvil", "llamar", "llame", "llamada")
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "kontakt", "schreiben", "courriel", "contacter", "écrire", "correo", "contacto", "escribir"),
    "ip": ("ip", "address", "host", "server", "adresse", "rechner", "serveur", "hôte", "dirección", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "kreditkarte", "zahlung", "carte", "crédit", "paiement", "tarjeta", "crédito", "pago"),
    "phone": _CALL,
    "iban": ("iban", "account", "bank", "konto", "kontonummer", "überweisung", "compte", "banque", "virement", "cuenta", "banco", "transferencia"),
    "ssn": ("ssn", "social security", "sozialversicherung", "sozialversicherungsnummer", "sécurité sociale", "seguridad social", "seguro social"),
    "national_phone": _CALL,
}
_NEAR = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)") for kind, words in CONTEXT.items()}
#: added kinds whose checksum is proof enough to stay even where a base span lies within
CONFIRMED = ("iban",)
NEARBY, GAIN, THRESHOLD = 40, 0.3, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go to the end, letters become numbers, the remainder by 97 is 1."""
    packed = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """Spans of addresses, found from each ``@`` outwards: the same spans as a search from the left, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        at = text.find("@", max(done, at + 1))


def ibans(text: str):
    """Spans of IBANs. Capitals or digits after a space may belong to the number or to the next word: the country's
    length tells, for a country without one the longest end at a border that fits. A start that fails costs only itself."""
    done = 0
    for start in _IBAN.finditer(text):
        begin, at = start.span()
        if begin < done:
            continue
        n = IBAN_LENGTHS.get(text[begin:begin + 2])
        rest = (_IBAN_REST_OF[n] if n else _IBAN_REST).match(text, at)
        while rest:
            if mod97(text[begin:rest.end()]):
                done = rest.end()
                yield begin, done
                break
            shorter = 0 if n else len(rest[0].replace(" ", "")) - 1
            rest = next((m for k in range(shorter, 10, -1) if (m := _IBAN_REST_OF[k + 4].match(text, at))), None)


def _valid_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _valid_card(s: str) -> bool:
    d = digits_of(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _valid_phone(s: str) -> bool:
    return 8 <= len(digits_of(s)) <= 15


_SEARCHES = (("ip", _IP, _valid_ip), ("card", _CARD, _valid_card), ("phone", _PHONE, _valid_phone),
             ("ssn", _SSN, lambda s: True), ("national_phone", _NATIONAL, lambda s: True))


def score(text: str, kind: str, begin: int, end: int) -> float:
    left = max(0, begin - NEARBY)
    # one more character on the far side tells whether a word there is whole
    before, after = text[max(0, left - 1):begin].lower(), text[end:end + NEARBY + 1].lower()
    behind = _NEAR[kind].search(after)
    found = _NEAR[kind].search(before, min(left, 1)) is not None or behind is not None and behind.end() <= NEARBY
    return round(min(1.0, START[kind] + GAIN * found), 3)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; added kinds stay if they reach THRESHOLD and, unless CONFIRMED, share nothing with a base span."""
    by_kind: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        by_kind["email"] = list(emails(text))
    by_kind["iban"] = list(ibans(text))
    for kind, pattern, valid in _SEARCHES:
        if kind == "phone" and "+" not in text:
            continue
        by_kind[kind] = [m.span() for m in pattern.finditer(text) if valid(m[0])]
    base = sorted(s for k in BASE_KINDS for s in by_kind[k])
    out = []
    for kind in KINDS:
        for begin, end in by_kind[kind]:
            points = score(text, kind, begin, end)
            if kind not in BASE_KINDS and (points < THRESHOLD or kind not in CONFIRMED and any(b < end and begin < e for b, e in base)):
                continue
            out.append((kind, begin, end, points))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end, score) in code points, end exclusive, for each row of ``docs``.

    A NULL or empty text has no span; repeated rows and NULL ids are kept; an empty table gives no rows.
    """
    rows = texts_of(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def step(batch):
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "spans": pa.array(found, kind)}

    return per_batch(rows, step, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                 "spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def digests(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text."""
    def listed(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))
    return spans.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"),
                        F.transform("spans", lambda s: s.score).alias("scores"))


def redact(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; spans that overlap go as one, named by the longest, then the first of them."""
    out, done, held = [], 0, None
    for kind, begin, end, _ in [*sorted(find_spans(text), key=lambda s: (s[1], KINDS.index(s[0]))), (None, len(text) + 1, 0, 0)]:
        if held and begin < held[2]:
            held = (kind if end - begin > held[3] else held[0], held[1], max(end, held[2]), max(end - begin, held[3]))
            continue
        if held:
            out += [text[done:held[1]], f"<{held[0]}>"]
            done = held[2]
        held = (kind, begin, end, end - begin)
    return "".join(out) + text[done:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, if there, counted anew; a NULL text stays NULL."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([t and redact(t) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
