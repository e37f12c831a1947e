"""The Snowball stemmer of Russian, after its published definition."""

from __future__ import annotations

import re

# Endings of the published algorithm. Those of a first group must follow а or я.
VOWELS = "аеиоуыэюя"
GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
REFLEXIVE = "ся сь"
VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
SUPERLATIVE = "ейш ейше"
DERIVATIONAL = "ост ость"


def _ending(after: str, free: str) -> re.Pattern:
    """The longest ending, at the end of a text."""
    ways = [(e, f"(?<=[ая]){e}") for e in after.split()] + [(e, e) for e in free.split()]
    return re.compile("(?:" + "|".join(w for _, w in sorted(ways, key=lambda x: -len(x[0]))) + ")$")


_GERUND, _VERB, _PARTICIPLE = (_ending(*x) for x in (GERUND, VERB, PARTICIPLE))
_ADJECTIVE, _REFLEXIVE, _NOUN, _SUPERLATIVE, _DERIVATIONAL = (_ending("", x) for x in (ADJECTIVE, REFLEXIVE, NOUN, SUPERLATIVE, DERIVATIONAL))
_RV = re.compile(f"[{VOWELS}]")
_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")


def russian(word: str) -> str:
    """The stem of a lower-case Russian word with е for ё."""
    first = _RV.search(word)
    if not first:
        return word
    head, rv = word[: first.end()], word[first.end() :]
    r1 = _REGION.search(word)
    r2 = _REGION.search(word, r1.end()) if r1 else None
    r2_at = r2.end() if r2 else len(word)

    if (cut := _GERUND.sub("", rv, count=1)) != rv:
        rv = cut
    else:
        rv = _REFLEXIVE.sub("", rv, count=1)
        if (cut := _ADJECTIVE.sub("", rv, count=1)) != rv:
            rv = _PARTICIPLE.sub("", cut, count=1)
        elif (cut := _VERB.sub("", rv, count=1)) != rv:
            rv = cut
        else:
            rv = _NOUN.sub("", rv, count=1)
    rv = rv.removesuffix("и")
    found = _DERIVATIONAL.search(rv)
    if found and len(head) + found.start() >= r2_at:
        rv = rv[: found.start()]
    cut = _SUPERLATIVE.sub("", rv, count=1)
    if cut.endswith("нн"):
        rv = cut[:-1]
    elif cut != rv:
        rv = cut
    else:
        rv = rv.removesuffix("ь")
    return head + rv
