"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, telephone numbers, payment cards, IBANs, US social security numbers, IPv4 addresses, keys
and passwords, and names: after a title ("Dr.", "Frau", before 先生 or 씨), after words that announce one ("my name is",
"Dear", "Author:"), and common given names before a capitalised word. Every entity has a canonical form, shared by all its mentions; the surrogate is
a keyed function of kind, canonical form and attempt, so one person stays one person in all documents. Each mention gets
it in its own format: punctuation, spacing, letter case, country code, check digits. Names keep gender (of the title or
of a known given name) and script; they are built from syllables, so that even first draws seldom meet.

Collision checks hold entities apart: where two entities of a kind got the same surrogate, or a surrogate is an entity
of the input, all but one take the next attempt, until none collide. Only such entities travel back to their documents;
for all others the function alone gives the surrogate, so texts are not shuffled unless collisions outgrow a broadcast.

Defined results: a null text stays null, an empty one empty. Rows that repeat, and equal mentions, get equal surrogates.
Overlapping matches go to the kind first in KINDS. A run of one symbol after "password:" and the like is an underline or a
mask, no secret; other values without a letter or digit get drawn symbols. Where a format is used up, surrogates grow. No
rows give no rows; other columns are left out (`replace` keeps those of documents). Texts are searched whole, and
entities of any length are replaced whole.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A key of one's own keeps surrogates from being recomputed by others.
KEY = "sieveworks surrogates"
KINDS = ("email", "iban", "card", "secret", "ssn", "ip", "phone", "given", "family")
#: From this attempt on the format counts as used up, and each further attempt draws one more digit.
WIDER_FROM = 32

# Common given names by script and gender, from which a name's gender and its start are told.
GIVEN = {
    ("latin", "f"): "Alice Amy Angela Anna Barbara Betty Carol Clara Emily Emma Eva Helen Helena Irene Jane Jennifer Jessica Judith Julia Karen Laura Linda Lisa Lucia Margaret Maria Marta Mary Nancy Patricia Paula Rosa Ruth Sandra Sara Sarah Sofia Susan".split(),
    ("latin", "m"): "Adam Alan Andrew Anthony Brian Bruno Carlos Charles Christopher Daniel David Edward Erik Felix Frank Georg George Hans Henry Ivan Jakob James John Joseph Karl Kevin Luis Mark Martin Michael Nils Oscar Paul Peter Richard Robert Simon Steven Thomas Victor William".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Нина Вера Юлия Дарья Софья".split(),
    ("cyrillic", "m"): "Иван Пётр Борис Павел Сергей Олег Антон Денис Роман Юрий".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Ειρήνη Δήμητρα Χριστίνα Ιωάννα".split(),
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Κώστας Δημήτρης Ανδρέας Στέφανος Μιχάλης".split(),
}
#: Syllables (or characters) of which surrogates are made, by script; and endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе би бо ва ве ви га го да де ди ка ко ла ле ли ма ме ми на не ни но па по ра ре ри ро са се та те ти то".split(),
    "greek": "βα βε γα γο δα δε ζα κα κε κο λα λε λι μα με μι να νε νι πα πε πο ρα ρε ρο σα σε τα τε το".split(),
    "han": list("安博晨德东方光国海和宏华建江杰景凯康可乐林龙明宁平青庆荣瑞山世书思天文心新星雅阳义永宇元云泽志中子"),
    "kana": list("あいうえおかきくけこさしすせそたちつてとなにねのはひふへほまみむめもやゆよらりるれろわ"),
    "hangul": list("가강경고광국기나다도동라리마명미민바보비사상서선성소수승아안연영예오용우원유은이인자재정종주준지진찬태하현혜호희"),
    "arabic": "با بي تا جا حا دا را سا شا عا فا كا لا ما نا ها يا دي ري سي في كي لي مي ني".split(),
    "hebrew": "בא גא דא הא זא חא לא מא נא סא פא רא שא תא בי גי די לי מי ני סי רי שי תי".split(),
    "devanagari": "का गा चा जा ता दा ना पा बा मा या रा ला वा सा हा कि गि नि मि रि ली सी".split(),
}
_ENDINGS = {("latin", "f"): "na", ("latin", "m"): "ro", ("cyrillic", "f"): "на", ("cyrillic", "m"): "ил", ("greek", "f"): "νη", ("greek", "m"): "ος"}
#: Last letters of the scripts' ranges of code points; what is in none counts as Latin.
_RANGES = (("greek", "Ͱ", "Ͽ"), ("cyrillic", "Ѐ", "ԯ"), ("hebrew", "֐", "׿"), ("arabic", "؀", "ۿ"), ("devanagari", "\u0900", "\u097f"), ("greek", "ἀ", "῿"), ("kana", "\u3040", "ヿ"), ("han", "一", "鿿"), ("hangul", "가", "힣"))
#: Titles by gender (u: of either).
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Dame Frau Madame Mme Mademoiselle Señora Sra Doña Signora госпожа κυρία السيدة גברת श्रीमती".split(),
    "m": "Mr Mister Sir Lord Herr Monsieur Señor Sr Don Signor господин κύριος السيد מר श्री".split(),
    "u": "Dr Doctor Prof Professor Doktor".split(),
}
_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_AFTER = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "さん": "u", "様": "u", "씨": "u", "님": "u"}
_KNOWN = {n.lower(): g for (_, g), names in GIVEN.items() for n in names}
#: Words after "Dear" and the like that are no names.
_NOBODY = frozenset("sir sirs madam all team customer customers friend friends colleague colleagues editor reader readers parent parents student students member members everyone user guest god diary the our my".split())
_NAME = r"(?:[^\W\d_a-zà-öø-ÿа-яё\u0900-\u097f]['’]?[^\W\d_]+(?:-[^\W\d_]+)*|[\u0900-\u097f]{2,})"
# Patterns that begin with plain letters are searched fastest; what may not stand before them is checked afterwards.
_TITLE = re.compile(r"(?:" + "|".join(sorted({x for t in _GENDER for x in (t, t.capitalize())}, key=len, reverse=True)) + r")(?![^\W_]|[\u0900-\u097f])\.?(?=\s)")
_CUE = re.compile(r"\b(?:[Mm]y name is|I am called|[Dd]ear|[Ss]incerely|[Rr]egards|[Yy]ours (?:truly|faithfully)|[Ss]igned(?: by)?|[Ww]ritten by),?(?=\s)|\b(?:Name|Author|Contact|Attn|Patient|Signed)\s*:(?=\s)")
_NAMES = re.compile(rf"\s+({_NAME})(?:[ \t]+({_NAME}))?(?:[ \t]+({_NAME}))?")
_FULL = re.compile(r"(?:" + "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True)) + rf")(?=[ \t]+{_NAME})")
_BEFORE = re.compile(r"([王李张張刘劉陈陳杨楊黄黃赵趙吴吳周徐孙孫马馬朱胡郭何高林罗羅][一-鿿]{1,2}(?=先生|女士|小姐|太太)|(?<![一-鿿])[一-鿿]{2,4}(?=さん|様)|(?<![가-힣])[가-힣]{2,4}(?= ?[씨님](?![가-힣])))")
#: Texts without any of these hold no announcement.
_CUE_PARTS = ("name is", "am called", "Dear", "dear", "incerely", "egards", "ours truly", "ours faithfully", "igned", "ritten by", "Name", "Author", "Contact", "Attn", "Patient")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_=.\-]{6,})")
_SYMBOLS = "+/_=.-"
_CLOUD_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}(?:[ .-]\d{2,4}){1,3}(?!\w)|(?<![\w.])\+\d{8,14}(?!\w)")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_sound(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def script_of(text: str) -> str:
    x = next((c for c in text if c.isalpha()), "a")
    return next((s for s, low, high in _RANGES if low <= x <= high), "latin")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: a domain after an @, and all before it that can be of an address."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < at and not text[begin].isalnum():
            begin += 1
        if begin < at and text[at - 1] != "." and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, done
        at = text.find("@", max(at + 1, done))


def _named(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Given and family names, by titles, announcements and common given names."""

    def of(spans: list[tuple[int, int]], gender: str) -> Iterator[tuple[int, int, str, str]]:
        for k, (a, b) in enumerate(spans):
            last = k == len(spans) - 1
            name = text[a:b].lower()
            yield a, b, "family" if last else "given", name + ("" if last else "/" + _KNOWN.get(name, gender))

    begins = lambda m: not m.start() or not text[m.start() - 1].isalnum()
    for t in _TITLE.finditer(text):
        if begins(t) and (m := _NAMES.match(text, t.end())):
            yield from of([m.span(k) for k in (1, 2, 3) if m[k]], _GENDER[t[0].rstrip(".").lower()])
    for c in _CUE.finditer(text) if any(map(text.__contains__, _CUE_PARTS)) else ():
        if (m := _NAMES.match(text, c.end())) and m[1].lower() not in _NOBODY and m[1].lower() not in _GENDER:
            spans = [m.span(k) for k in (1, 2, 3) if m[k]]
            if len(spans) == 1 and m[1].lower() in _KNOWN:
                yield *spans[0], "given", m[1].lower() + "/" + _KNOWN[m[1].lower()]
            else:
                yield from of(spans, "u")
    for f in filter(begins, _FULL.finditer(text)):
        m = _NAMES.match(text, f.end())
        yield from of([f.span(), *(m.span(k) for k in (1, 2) if m[k])], "u")
    if not text.isascii() and any(map(text.__contains__, _AFTER)):
        for m in _BEFORE.finditer(text):
            (a, b), gender = m.span(), next((g for mark, g in _AFTER.items() if text.startswith(mark, m.end()) or text.startswith(" " + mark, m.end())), "u")
            yield a, a + 1, "family", text[a]
            yield a + 1, b, "given", text[a + 1 : b] + "/" + gender


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions (start, end, kind, canonical form) in order, none overlapping another."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(a, b, "email", text[a:b].lower()) for a, b in _emails(text)]
    if any(map(text.__contains__, "0123456789")):
        for m in _IBAN.finditer(text):
            if _iban_sound(m[0]):
                found.append((*m.span(), "iban", m[0].replace(" ", "")))
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if len(digits) >= 15 or _luhn(digits):
                found.append((*m.span(), "card", digits))
        for m in _SSN.finditer(text):
            found.append((*m.span(), "ssn", m[0]))
        for m in _IP.finditer(text):
            found.append((*m.span(), "ip", m[0]))
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            if 8 <= len(digits) <= 15:
                found.append((*m.span(), "phone", digits[1:] if len(digits) == 11 and digits[0] == "1" else digits))
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if m[1][0] not in _SYMBOLS or len(set(m[1])) > 1:
                found.append((*m.span(1), "secret", m[1]))
    if "AKIA" in text or "ASIA" in text:
        for m in _CLOUD_KEY.finditer(text):
            found.append((*m.span(), "secret", m[0]))
    found += _named(text)
    found.sort(key=lambda x: (x[0], KINDS.index(x[2]), -x[1]))
    kept: list[tuple[int, int, str, str]] = []
    for x in found:
        if kept and x[0] < kept[-1][1]:
            if KINDS.index(x[2]) >= KINDS.index(kept[-1][2]):
                continue
            kept.pop()
        kept.append(x)
    return kept


class _Draws:
    """Endless keyed draws for one entity and attempt."""

    def __init__(self, key: str, kind: str, canonical: str, attempt: int):
        self.seed, self.count, self.pool = f"{kind}\0{canonical}\0{attempt}".encode(), 0, 0
        self.key, self.left = key.encode(), 1

    def below(self, n: int) -> int:
        while self.left < n << 32:
            block = hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.count = self.pool << 256 | int.from_bytes(block, "big"), self.left << 256, self.count + 1
        self.pool, found = divmod(self.pool, n)
        self.left //= n
        return found

    def shaped(self, text: str) -> str:
        """Letters for letters, digits for digits; hexadecimal text stays hexadecimal. Without either, symbols for symbols."""
        body = re.sub(r"[^0-9A-Za-z]", "", text)
        hexadecimal = re.fullmatch(r"(?=.*\d)(?:[0-9a-f]{8,}|[0-9A-F]{8,})", body) and not body.isdigit()
        if not body:
            return "".join(_SYMBOLS[self.below(len(_SYMBOLS))] for _ in text)
        sets = {"l": "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"}
        out = []
        for c in text:
            if c.isdigit() and c.isascii():
                out.append(str(self.below(10)))
            elif c.isascii() and c.isalpha():
                x = sets["l"][self.below(len(sets["l"]))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def surrogate(kind: str, canonical: str, attempt: int, key: str = KEY) -> str:
    """The canonical form of the replacement."""
    draw = _Draws(key, kind, canonical, attempt)
    wider = lambda: "".join(str(draw.below(10)) for _ in range(attempt - WIDER_FROM + 1))
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        own = ".".join([draw.shaped(x) for x in labels[:-1]] + ["example", "com"])
        return (draw.shaped(local) if re.search(r"[a-z0-9]", local) else "x") + "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(attempt // 4)) + "@" + own
    if kind == "card":
        digits = canonical[0] + "".join(str(draw.below(10)) for _ in canonical[1:]) + wider()
        return next(x for d in "0123456789" if _luhn(x := digits[:-1] + d)) if _luhn(canonical) else digits
    if kind == "iban":
        body = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw.below(26)] if c.isalpha() else str(draw.below(10)) for c in canonical[4:]) + wider()
        check = 98 - int("".join(str(int(c, 36)) for c in body + canonical[:2] + "00")) % 97
        return f"{canonical[:2]}{check:02d}{body}"
    if kind == "ssn":
        return f"{900 + draw.below(100)}-{10 + draw.below(90)}-{draw.below(10000):04d}{wider()}"
    if kind == "ip":
        return f"{1 + draw.below(223)}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}{wider()}"
    if kind == "phone":
        if len(canonical) == 10:
            middle = "555" if canonical[3:6] == "555" and attempt < 8 else f"{2 + draw.below(8)}{draw.below(100):02d}"
            return f"{2 + draw.below(8)}{draw.below(100):02d}{middle}{draw.below(10000):04d}{wider()}"
        return canonical[:2] + "".join(str(draw.below(10)) for _ in canonical[2:]) + wider()
    if kind in ("given", "family"):
        name, _, gender = canonical.partition("/")
        script = script_of(name)
        sounds, short = SYLLABLES[script], script in ("han", "kana", "hangul")
        count = (1 if kind == "family" else 2) + attempt if short else 3 + attempt // 2
        base = "".join(sounds[draw.below(len(sounds))] for _ in range(count))
        return base + (_ENDINGS.get((script, gender if gender in "fm" else "fm"[draw.below(2)]), "") if kind == "given" else "")
    return (canonical[:4] + draw.shaped(canonical[4:]) if re.fullmatch(r"A[KS]IA[0-9A-Z]{16}", canonical) else draw.shaped(canonical)) + wider()


def in_format(mention: str, kind: str, canonical: str, replacement: str) -> str:
    """The replacement written as the mention was."""
    if kind in ("card", "phone", "iban"):
        slots = [i for i, c in enumerate(mention) if c.isdigit() or (kind == "iban" and c.isalpha())]
        out = list(mention)
        for i, c in zip(reversed(slots), reversed(replacement[: len(canonical)]), strict=False):
            out[i] = c
        return "".join([*out, replacement[len(canonical) :]])
    if kind in ("given", "family"):
        return replacement.upper() if mention.isupper() and len(mention) > 1 else "-".join(x.capitalize() for x in replacement.split("-"))
    if kind == "email" and mention != canonical:
        return replacement.upper() if mention.isupper() else replacement
    return replacement


def rewritten(text: str, attempts: dict[tuple[str, str], int], key: str = KEY) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and its mentions."""
    mentions = find(text)
    out, at = [], 0
    for a, b, kind, canonical in mentions:
        out += [text[at:a], in_format(text[a:b], kind, canonical, surrogate(kind, canonical, attempts.get((kind, canonical), 0), key))]
        at = b
    return "".join([*out, text[at:]]), mentions


def entities(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, hash of the text, kind, canonical): the different entities of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, h, k, c) for d, h, t in zip(*(b.column(x).to_pylist() for x in ("doc_id", "hash", "text")), strict=True) for k, c in dict.fromkeys((x[2], x[3]) for x in find(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "hash", "kind", "canonical"])

    return _hashed(common.documents(docs)).mapInArrow(run, "doc_id long, hash long, kind string, canonical string")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def collisions(found: DataFrame, key: str = KEY) -> DataFrame:
    """Rows (kind, canonical, attempt) of the entities that can't take their first surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [surrogate(k, c, a, key) for k, c, a in zip(*(b.column(x).to_pylist() for x in ("kind", "canonical", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "made"])

    own = common.cut(found.select("kind", "canonical").distinct())
    taken = own.select("kind", F.when(F.col("kind") == "given", F.split_part("canonical", F.lit("/"), F.lit(1))).otherwise(F.col("canonical")).alias("made")).distinct().withColumn("taken", F.lit(True))
    state = own.withColumn("attempt", F.lit(0))
    while True:  # ends, as the draws of those left grow with each round
        made = common.cut(state.mapInArrow(run, "kind string, canonical string, attempt int, made string"))
        first = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n"))
        first = first.join(taken, ["kind", "made"], "left").filter("n > 1 or taken")
        judged = made.join(first, ["kind", "made"], "left")
        again = F.coalesce(F.col("taken") | (F.col("first.canonical") != F.col("canonical")), F.lit(False))
        losers = judged.select("kind", "canonical", "attempt", again.alias("again"))
        state = common.cut(losers.select("kind", "canonical", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"), "again"))
        if state.filter("again").isEmpty():
            return state.filter("attempt > 0").select("kind", "canonical", "attempt")
        state = state.drop("again")


def _with_attempts(docs: DataFrame, key: str) -> DataFrame:
    """Documents with the list of their entities that don't take the first attempt."""
    spark = docs.sparkSession
    path, more = common.new_path(spark, "entities"), common.new_path(spark, "collisions")
    entities(docs).write.parquet(path)
    found = spark.read.parquet(path)
    other = found.join(collisions(found, key), ["kind", "canonical"]).groupBy(F.col("doc_id").alias("key"), F.col("hash").alias("key_hash")).agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("attempts"))
    other.write.parquet(more)  # read back, its size is known: Spark broadcasts it only below spark.sql.autoBroadcastJoinThreshold
    common.remove(spark, path)
    other = spark.read.schema(other.schema).parquet(more)
    return _hashed(docs).join(other, F.col("doc_id").eqNullSafe(F.col("key")) & (F.col("hash") == F.col("key_hash")), "left").drop("key", "key_hash", "hash")


def _replaced(batch: pa.RecordBatch, key: str) -> tuple[list[str | None], list[list]]:
    texts, mentions = [], []
    for text, other in zip(batch.column("text").to_pylist(), batch.column("attempts").to_pylist(), strict=True):
        new, found = (None, []) if text is None else rewritten(text, {(x["kind"], x["canonical"]): x["attempt"] for x in other or ()}, key)
        texts.append(new)
        mentions.append(found)
    return texts, mentions


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the rewritten text, the number of mentions, and how many there are of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, mentions = _replaced(batch, key)
            kinds = [",".join(f"{k}:{n}" for k in KINDS if (n := sum(x[2] == k for x in m))) for m in mentions]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string()), "n_entities": pa.array([len(m) for m in mentions], pa.int64()), "kinds": pa.array(kinds, pa.string())})

    return _with_attempts(common.documents(docs), key).select("doc_id", "text", "attempts").mapInArrow(run, "doc_id long, text string, n_entities long, kinds string")


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Documents with surrogates for personal data."""
    docs = common.only(docs, **common.DOCUMENT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "lang", "source")} | {"text": pa.array(_replaced(batch, key)[0], pa.string())})

    done = _with_attempts(docs, key).select("doc_id", "lang", "source", "text", "attempts").mapInArrow(run, "doc_id long, lang string, source string, text string")
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
