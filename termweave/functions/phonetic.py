"""Phonetic rewriting: ordered rules over phones, and native normalizers for the rule sets that settle.

A word's phones are its characters, vowels (aeiou) and consonants. A rewrite takes the first rule, in order, that
fits anywhere, at the first place where it fits, and starts over, until none fits or the fuel is spent.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiou"
#: Fuel is the number of phones times the number of rules times this.
EXPANSION = 20


@dataclass(frozen=True)
class Rule:
    """context: anywhere, initial, final, before_vowel, after_consonant, before_consonant, after_vowel; letters narrow it."""

    number: int
    pattern: str
    replacement: str
    context: str = "anywhere"
    letters: str = ""
    at_next: bool = False  # look at the phone behind the pattern, not at the pattern's own start
    inert: bool = False  # never fits a word cut into characters: its pattern takes a vowel letter for a consonant

    def fits(self, word: str, at: int) -> bool:
        if not word.startswith(self.pattern, at):
            return False
        end = at + len(self.pattern)
        here = word[end : end + 1] if self.at_next else word[at : at + 1]
        before = word[at - 1 : at] if at else ""
        letters = self.letters or (VOWELS if "vowel" in self.context else "")
        match self.context:
            case "anywhere":
                return True
            case "initial":
                return at == 0
            case "final":
                return (end if self.at_next else at) == len(word)
            case "before_vowel":
                return here != "" and here in VOWELS and here in letters
            case "after_vowel":
                return before != "" and before in VOWELS and before in letters
            case "before_consonant":
                return here != "" and here not in VOWELS and (not letters or here in letters)
            case "after_consonant":
                return before != "" and before not in VOWELS and (not letters or before in letters)
        raise ValueError(self.context)


# Rules in their order. The sh and ch sounds are one symbol each.
ORTHOGRAPHY = (
    Rule(1, "ch", "ç"),
    Rule(2, "sh", "$"),
    Rule(3, "ph", "f"),
    Rule(20, "c", "s", "before_vowel", "ie"),
    Rule(21, "c", "k"),
    Rule(22, "g", "j", "before_vowel", "ie"),
    Rule(33, "e", "", "final"),
    Rule(34, "gh", ""),
)
PHONETIC = (Rule(100, "th", "t"), Rule(101, "qu", "kw", inert=True), Rule(102, "kw", "qu"))
EXPANDING = (Rule(200, "x", "yy"), Rule(201, "y", "z"))
ZOMPIST = ORTHOGRAPHY + PHONETIC + EXPANDING
#: What the contexts mean to say: the phone behind the pattern decides.
INTENDED = tuple(Rule(r.number, r.pattern, r.replacement, r.context, r.letters, True) for r in ORTHOGRAPHY)


def rewrite(word: str, rules=ORTHOGRAPHY, fuel: int | None = None) -> str:
    """Apply the rules to one word."""
    usable = [r for r in rules if not r.inert]
    for _ in range(len(word) * len(rules) * EXPANSION if fuel is None else fuel):
        hit = next(((r, k) for r in usable for k in range(len(word) + 1) if r.fits(word, k)), None)
        if hit is None:
            break
        r, k = hit
        word = word[:k] + r.replacement + word[k + len(r.pattern) :]
    return word


def orthography(word: Column) -> Column:
    """The orthography rules that can fire, natively. ``gh`` goes as often as it comes up, as a pair of brackets would; only that makes
    room for earlier rules, ``sh`` and ``ph``, which come once more."""
    for pattern, replacement in (("ch", "ç"), ("sh", "$"), ("ph", "f"), ("c", "k")):
        word = F.replace(word, F.lit(pattern), F.lit(replacement))
    step = lambda done, c: F.when((c == "h") & done.endswith("g"), F.substring(done, F.lit(1), F.length(done) - 1)).otherwise(F.concat(done, c))
    word = F.when(F.contains(word, F.lit("gh")), F.aggregate(F.split(word, ""), F.lit(""), step)).otherwise(word)
    for pattern, replacement in (("sh", "$"), ("ph", "f")):
        word = F.replace(word, F.lit(pattern), F.lit(replacement))
    return word


def normalize(word: Column, rules=ORTHOGRAPHY) -> Column:
    """Any rule set; the orthography rules natively, others through an Arrow UDF over distinct words of a batch."""
    if rules is ORTHOGRAPHY:
        return orthography(word)

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map({w: None if w is None else rewrite(w, rules) for w in set(words)})

    return run(word)
