"""Substitution pairs and weighted operations."""

from __future__ import annotations


def both_ways(*pairs: tuple[str, str]) -> frozenset[tuple[str, str]]:
    return frozenset(p for x, y in pairs for p in ((x, y), (y, x)))


def _pairs(text: str) -> frozenset[tuple[str, str]]:
    return both_ways(*((p[0], p[1]) for p in text.split()))


def _variants(table: dict[str, str]) -> frozenset[tuple[str, str]]:
    return both_ways(*((v, base) for base, variants in table.items() for v in variants))


# Pairs of characters that match each other. An empty partner stands for a silent letter and never matches.
PHONETIC_BASIC = _pairs("fp ck cs sz ae iy") | {("h", ""), ("k", "")}
KEYBOARD_QWERTY = _pairs("qw we er rt ty yu ui io op as sd df fg gh hj jk kl zx xc cv vb bn nm qa ws ed rf tg yh uj ik ol")
LEET_SPEAK = _pairs("e3 a@ a4 o0 i1 l1 s$ s5 t7 b8 g9")
OCR_FRIENDLY = _pairs("0O 0o 1I 1l Il 8B 5S 6G 2Z")
DIACRITICS_LATIN = _variants({"a": "áàâäãåæ", "e": "éèêë", "i": "íìîï", "o": "óòôöõøœ", "u": "úùûü", "n": "ñ", "c": "ç", "s": "ß", "A": "ÁÀÂÄÃÅÆ", "E": "ÉÈÊË", "I": "ÍÌÎÏ", "O": "ÓÒÔÖÕØŒ", "U": "ÚÙÛÜ", "N": "Ñ", "C": "Ç"})
GREEK_CASE_INSENSITIVE = _pairs("Αα Ββ Γγ Δδ Εε Ζζ Ηη Θθ Ιι Κκ Λλ Μμ Νν Ξξ Οο Ππ Ρρ Σσ Σς Ττ Υυ Φφ Χχ Ψψ Ωω")
CYRILLIC_CASE_INSENSITIVE = _pairs("Аа Бб Вв Гг Дд Ее Ёё Жж Зз Ии Йй Кк Лл Мм Нн Оо Пп Рр Сс Тт Уу Фф Хх Цц Чч Шш Щщ Ъъ Ыы Ьь Ээ Юю Яя")
JAPANESE_HIRAGANA_KATAKANA = _pairs("あア いイ うウ えエ おオ かカ きキ くク けケ こコ さサ しシ すス せセ そソ たタ ちチ つツ てテ とト")


class Substitutions:
    """A directional set of (term's part, query's part) pairs."""

    def __init__(self, pairs=()):
        self.pairs: set[tuple[str, str]] = set(pairs)

    def allow(self, source: str, target: str) -> Substitutions:
        self.pairs.add((source, target))
        return self

    def contains(self, source: str, target: str) -> bool:
        return (source, target) in self.pairs

    def has_source(self, source: str) -> bool:
        return any(s == source for s, _ in self.pairs)

    def has_target_starting_with(self, source: str, first: str) -> bool:
        return any(s == source and t.startswith(first) for s, t in self.pairs)

    def __iter__(self):
        return iter(sorted(self.pairs))

    def __len__(self) -> int:
        return len(self.pairs)


def operation(name: str, consume_x: int, consume_y: int, weight: float, pairs=None) -> dict:
    if weight < 0 or (weight == 0 and consume_x != consume_y):
        raise ValueError("weights are not negative, and free operations keep the length")
    return {"name": name, "consume_x": consume_x, "consume_y": consume_y, "weight": weight, "pairs": None if pairs is None else list(pairs)}


STANDARD_OPERATIONS = [operation("match", 1, 1, 0.0), operation("substitute", 1, 1, 1.0), operation("insert", 0, 1, 1.0), operation("delete", 1, 0, 1.0)]
WITH_TRANSPOSITION = [*STANDARD_OPERATIONS, operation("transpose", 2, 2, 1.0)]
WITH_MERGE_SPLIT = [*STANDARD_OPERATIONS, operation("merge", 2, 1, 1.0), operation("split", 1, 2, 1.0)]

# Spellings that sound alike, and what exchanging them costs.
_DIGRAPHS = [("ch", "k"), ("sh", "s"), ("ph", "f"), ("th", "t")]
_CLUSTERS = [("wr", "r"), ("wh", "w"), ("kn", "n"), ("ps", "s"), ("pn", "n"), ("gn", "n"), ("rh", "r")]
_turned = lambda pairs: [(y, x) for x, y in pairs]
CONSONANT_DIGRAPHS = [operation("digraph_to_letter", 2, 1, 0.15, _DIGRAPHS), operation("letter_to_digraph", 1, 2, 0.15, _turned(_DIGRAPHS)), operation("qu_kw", 2, 2, 0.15, [("qu", "kw"), ("kw", "qu")])]
INITIAL_CLUSTERS = [operation("cluster_to_letter", 2, 1, 0.20, _CLUSTERS), operation("letter_to_cluster", 1, 2, 0.20, _turned(_CLUSTERS))]
PHONETIC_CONFUSIONS = [operation("confusion", 1, 1, 0.25, sorted(_pairs("ck cs sz gj fv ae ie")))]
DOUBLE_CONSONANTS = [operation("double_to_single", 2, 1, 0.10, [(c + c, c) for c in "bcdfghjklmnpqrstvwxyz"])]
PHONETIC_ENGLISH_BASIC = [*STANDARD_OPERATIONS, *CONSONANT_DIGRAPHS, *INITIAL_CLUSTERS, *PHONETIC_CONFUSIONS, *DOUBLE_CONSONANTS]
