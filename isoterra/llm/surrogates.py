"""Personal data in stored responses replaced by keyed look-alikes.

Works on the library's stored responses (response_id, body). The same entity gets the same surrogate
everywhere, different entities get different ones, and no surrogate is an entity of the corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoterra.llm.batches import Lists, in_batches
from isoterra.spread import cut

# Forms of address by gender, syllables for names by script, and what may be personal at all.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Sir"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña"],
    "n": ["Dr", "Prof"],
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ha jo ka ke la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se si so ta te ti to va ve vi wa".split(),
    "cyrillic": "ба бе бо ва ве да де до за зе ка ке ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се си со та те ти то".split(),
    "arabic": [a + b for a in "بتجدرسفكلمنه" for b in "اوي"],
    "hebrew": [a + b for a in "בגדזלמנרשת" for b in "אוי"],
    "devanagari": list("कखगचजतदनपबमयरलवसह"),
    "han": list("安白成德东方国海和江金立林明平青山文新雨"),
    "kana": list("アイウエオカキクケコサシスセソタチテトナニノハマミモヤユラリル"),
    "hangul": list("가강경기나다도동라마민바보사서수영우유은이인재정주지진하현호"),
    "greek": "βα γα δα δη κα κη λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"m": ["n", "r", "s"], "f": ["a", "na", "la"], "n": ["n", "l", "m"]},
    "cyrillic": {"m": ["н", "р", "в"], "f": ["а", "на", "я"], "n": ["н", "л", "к"]},
    "arabic": {"m": ["ر", "ن", "د"], "f": ["ة", "ى", "اء"], "n": ["ل", "م", "ب"]},
    "hebrew": {"m": ["ן", "ר", "ל"], "f": ["ה", "ית", "ת"], "n": ["ם", "ב", "ד"]},
    "devanagari": {"m": ["न", "र", "त"], "f": ["आ", "ई", "इया"], "n": ["ल", "म", "य"]},
    "han": {"m": ["伟", "强", "军"], "f": ["芳", "娜", "丽"], "n": ["宁", "华", "春"]},
    "kana": {"m": ["オ", "ロウ", "タ"], "f": ["コ", "ミ", "エ"], "n": ["キ", "ミ", "オ"]},
    "hangul": {"m": ["훈", "준", "석"], "f": ["희", "미", "숙"], "n": ["연", "빈", "윤"]},
    "greek": {"m": ["ς", "ος", "ης"], "f": ["α", "η", "ια"], "n": ["ν", "ς", "ου"]},
}
# First and last letters by script; names of any other script get Latin surrogates.
LETTERS = {
    "greek": "Ͱ-Ͽ", "cyrillic": "Ѐ-ԯ", "hebrew": "א-ת", "arabic": "ؠ-ۿ", "devanagari": "ऀ-ॿ",
    "kana": "ぁ-ヿ", "han": "㐀-鿿", "hangul": "가-힣",
}
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
# What every match of the detectors below contains, for Java's matcher: an at sign; two digits with a digit or
# separator between them; a digit after a plus sign; a country code and a digit; a title and what may begin a
# name (a capital of ASCII or anything beyond ASCII). A digit is any that Python may know and Java may not yet.
_DIGIT = r"[\p{Nd}\p{Cn}]"
SUSPECT = rf"@|{_DIGIT}[\p{{Nd}}\p{{Cn}} .-]{_DIGIT}|\+{_DIGIT}|[A-Z]{{2}}{_DIGIT}|({_TITLE})\.? [^\x00-\x40\x5B-\x7F]"
_EMAIL = r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
_IP = r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
_PHONE = r"(?P<phone>\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{2,4}(?:[ -]?\d{2,4}){1,4}(?!\d)|(?<![\d.-])\(\d{2,4}\) ?\d{3}[ -]?\d{4}(?!\d)|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-]))"
_SSN = r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
_ACCOUNT = r"(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
_NAME = rf"(?:(?<!\w)(?P<title>{_TITLE})\.? )(?P<name>[^\W\d_a-z]\w+(?: [^\W\d_a-z]\w+)?)"
_ENTITY = re.compile("|".join([_EMAIL, _IP, _PHONE, _SSN, _ACCOUNT, _NAME]))
KINDS = ("email", "ip", "phone", "ssn", "iban", "card", "name")
# Redraws per entity before giving up; a format with fewer values than entities cannot keep them apart.
MOST_DRAWS = 200


@dataclass(frozen=True)
class Mention:
    """One entity in a text: its place, kind, canonical form, and for names the gender."""

    start: int
    end: int
    kind: str
    canonical: str
    gender: str = ""


def _gender(title: str) -> str:
    return next(g for g, titles in TITLES.items() if title in titles)


def _ascii(c: str) -> str:
    """A digit of any script as 0 to 9; other characters as they are."""
    return str(int(c)) if c.isdecimal() else c


def _like(digit: str, c: str) -> str:
    """A digit 0 to 9 in the script of another digit; the digits of a script follow each other."""
    return chr(ord(c) - int(c) + int(digit)) if c.isdecimal() and digit.isdecimal() else digit


def canonical(kind: str, text: str) -> str:
    """What all spellings of one entity share."""
    if kind in ("phone", "card", "ssn"):
        return "".join(_ascii(c) for c in text if c.isdecimal())
    if kind in ("iban", "ip"):
        text = "".join(map(_ascii, text))
    return text.replace(" ", "").upper() if kind == "iban" else text.casefold()


def mentions(body: str) -> list[Mention]:
    """Entities of a whole text from left to right."""
    found = []
    for match in _ENTITY.finditer(body):
        kind = match.lastgroup
        gender = _gender(match["title"]) if kind == "name" else ""
        found.append(Mention(*match.span(kind), kind, canonical(kind, match[kind]), gender))
    return found


class _Draws:
    """A keyed stream of small numbers for one entity and attempt."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.block, self.bytes = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return value % n

    def pick(self, values: list[str]) -> str:
        return values[self.below(len(values))]


def _luhn(digits: str) -> int:
    """Sum of the card check; a multiple of ten is valid."""
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled)


def _digits(draw: _Draws, text: str, keep: int = 0) -> str:
    """Other digits in the same places; the first digit of a run of digits stays no zero if it was none."""
    out = []
    for n, c in enumerate(text):
        out.append(c if n < keep or not c.isdigit() else str(1 + draw.below(9)) if n == 0 and c != "0" else str(draw.below(10)))
    return "".join(out)


def _script(word: str) -> str:
    first = next((c for c in word if c.isalpha()), "a")
    return next((s for s, (least, _, most) in LETTERS.items() if least <= first <= most), "latin")


def _name_word(draw: _Draws, word: str, gender: str, attempt: int = 0) -> str:
    """A word of about the same length; every second redraw adds a syllable, so short names never run out."""
    script = _script(word)
    count = max(1, min(4, len(word) // 2 - 1)) + draw.below(2) + attempt // 2
    return "".join(draw.pick(SYLLABLES[script]) for _ in range(count)) + draw.pick(ENDINGS[script][gender or "n"])


def surrogate(key: bytes, kind: str, entity: str, gender: str = "", attempt: int = 0) -> str:
    """Canonical surrogate of a canonical entity: same kind, script, length of digit groups and gender."""
    draw = _Draws(key, kind, entity, gender, attempt)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        # Mail addresses of one domain share the domain of their surrogates.
        house = _Draws(key, "domain", domain)
        new = ["".join(house.pick(SYLLABLES["latin"]) for _ in range(max(1, len(x) // 2))) for x in labels[:-1]]
        parts = [
            p if not p[:1].isalnum() else _digits(draw, p) if p.isdigit() else "".join(draw.pick(SYLLABLES["latin"]) for _ in range(2 + draw.below(2)))
            for p in re.split(r"([^\w]+)", local)
        ]
        local = "".join(parts)
        return f"{local if attempt < 3 else local + str(draw.below(10**6))}@{'.'.join([*new, labels[-1]])}"
    if kind == "ip":
        old = entity.split(".")
        private = old[0] == "10" or old[:2] == ["192", "168"]
        first = old[:1] if old[0] == "10" else old[:2] if private else [str(11 + draw.below(110))]
        return ".".join([*first, *[str(1 + draw.below(254)) for _ in range(4 - len(first))]])
    if kind == "card":
        digits = _digits(draw, entity, 1)
        if _luhn(entity) % 10 == 0:
            digits = digits[:-1] + "0"
            digits = digits[:-1] + str(-_luhn(digits) % 10)
        return digits
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in entity[4:])
        number = "".join(str(int(c, 36)) for c in body + entity[:2] + "00")
        return f"{entity[:2]}{98 - int(number) % 97:02d}{body}"
    if kind in ("phone", "ssn"):
        return _digits(draw, entity, 1 if kind == "phone" else 0)
    return " ".join(_name_word(_Draws(key, kind, w, gender, attempt), w, gender, attempt) for w in entity.split(" "))


def _dressed(original: str, kind: str, new: str) -> str:
    """The canonical surrogate in the format of one mention: separators, grouping, capitals."""
    if kind in ("phone", "card", "ssn", "iban"):
        letters = iter(new)
        return "".join(_like(next(letters), c) if c.isalnum() else c for c in original)
    if kind == "ip":
        return "".join(_like(c, original[0]) for c in new)
    if original.isupper():
        return new.upper()
    return new.title() if kind == "name" else new.capitalize() if original[:1].isupper() else new


def replaced(body: str, known: dict[tuple[str, str, str], str]) -> tuple[str, list[Mention]]:
    """A body with all its mentions replaced."""
    found, at, parts = mentions(body), 0, []
    for m in found:
        parts += [body[at : m.start], _dressed(body[m.start : m.end], m.kind, known[m.kind, m.canonical, m.gender])]
        at = m.end
    return "".join([*parts, body[at:]]), found


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, gender, surrogate): distinct surrogates, none of which is an entity itself.

    All entities draw; those whose draw is taken, or is an entity of the corpus, draw again until none is
    left. Clashes are found by joins on the surrogate, so no task sees all entities. Names and mail
    addresses grow with the redraws and never run out. A number keeps its digit groups, and a phone or card
    its first digit, an account its country, a private network address its network: where a corpus holds
    about half of all such numbers or more, there are not enough others, and no table is given but an
    error that tells the kinds, how many entities are left and the length of the shortest.
    """

    def draw(rows: DataFrame) -> DataFrame:
        def make(lists: Lists) -> Lists:
            lists["surrogate"] = [surrogate(key, k, c, g, a) for k, c, g, a in zip(lists["kind"], lists["canonical"], lists["gender"], lists["attempt"])]
            return lists

        return in_batches(rows, make, "kind string, canonical string, gender string, attempt int, surrogate string")

    fields = ["kind", "canonical", "gender"]
    originals = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("_real")).distinct()
    drawn = cut(draw(entities.select(*fields, F.lit(0).alias("attempt"))).withColumn("settled", F.lit(False)))
    for _ in range(MOST_DRAWS):
        # What was settled in an earlier round keeps its surrogate; among new draws the smallest entity does.
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct(~F.col("settled"), "canonical", "gender")).alias("_first"))
        judged = drawn.join(first, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
        own = (F.col("_first.canonical") == F.col("canonical")) & (F.col("_first.gender") == F.col("gender"))
        judged = cut(judged.select(*fields, "attempt", "surrogate", (own & F.col("_real").isNull()).alias("settled")))
        again = judged.where(~F.col("settled"))
        if again.isEmpty():
            return judged.select(*fields, "surrogate")
        redrawn = draw(again.select(*fields, (F.col("attempt") + 1).alias("attempt"))).withColumn("settled", F.lit(False))
        drawn = cut(judged.where("settled").unionByName(redrawn))
    left = drawn.where(~F.col("settled")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("canonical")).alias("size"))
    told = ", ".join(f"{r['n']} of kind {r['kind']} (from {r['size']} characters on)" for r in left.orderBy("kind").collect())
    raise ValueError(f"no distinct surrogates after {MOST_DRAWS} draws: {told}")


def replace_personal(responses: DataFrame, key: bytes, response_id: str = "response_id", body: str = "body") -> DataFrame:
    """All columns of the responses, `body` with surrogates, and `entities`: their count by kind
    (in place of a column of that name).

    Mail, network and phone addresses, identity, account and card numbers keep format and separators,
    cards and accounts their check digits; names after a form of address keep script, gender and capitals.
    A null body stays null without entities; a body without anything suspicious passes as it is and is
    never shuffled or copied; rows that repeat an id are replaced one by one; an empty table gives no rows. A body
    meets the surrogates of its entities by id and hash of the text, so an entity that stands in a third
    of all bodies is joined as short rows, which Spark can split.
    """
    kind = "kind string, canonical string, gender string"
    counts = "map<string,long>"
    responses = responses.drop("entities")
    entry = F.xxhash64(F.col(response_id), F.col(body))
    suspicious = F.coalesce(F.col(body).rlike(SUSPECT), F.lit(False))
    # Written once: the pattern costs most of the work, and three reads follow.
    suspects = cut(responses.where(suspicious).withColumn("_entry", entry))

    def find(lists: Lists) -> Lists:
        found = [(e, m) for e, text in zip(lists["_entry"], lists["_body"]) for m in {(m.kind, m.canonical, m.gender) for m in mentions(text)}]
        return {"_entry": [e for e, _ in found], **{c: [m[n] for _, m in found] for n, c in enumerate(("kind", "canonical", "gender"))}}

    listed = cut(in_batches(suspects.select("_entry", F.col(body).alias("_body")), find, f"_entry long, {kind}").distinct())
    known = assign(listed.select("kind", "canonical", "gender").distinct(), key)
    met = listed.join(known, ["kind", "canonical", "gender"])
    by_entry = met.groupBy("_entry").agg(F.collect_list(F.struct("kind", "canonical", "gender", "surrogate")).alias("_known"))

    columns = responses.columns
    joined = suspects.join(by_entry, "_entry").select(*columns, "_known")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in responses.schema.fields) + f", entities {counts}"

    def replace(lists: Lists) -> Lists:
        texts, found = [], []
        for text, pairs in zip(lists[body], lists.pop("_known")):
            new, own = replaced(text, {(p["kind"], p["canonical"], p["gender"]): p["surrogate"] for p in pairs})
            texts.append(new)
            found.append([(k, sum(m.kind == k for m in own)) for k in KINDS if any(m.kind == k for m in own)])
        return {**lists, body: texts, "entities": found}

    changed = in_batches(joined, replace, schema)
    nothing = F.expr(f"cast(map() as {counts})")
    plain_suspects = suspects.join(by_entry.select("_entry"), "_entry", "left_anti").select(*columns, nothing.alias("entities"))
    untouched = responses.where(~suspicious).select(*columns, nothing.alias("entities"))
    return untouched.unionByName(plain_suspects).unionByName(changed)
