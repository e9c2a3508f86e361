"""Plain versions that the operators are tested against."""

from __future__ import annotations

import unicodedata
from collections import defaultdict

from presencia.llm.leaks import words

SAME_SHAPE = dict(p for p in (
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ӀI ԚQ ѴV ԜW ҮY ӔÆ ӘƏ ԐƐ ӨƟ ӠƷ аa еe оo рp сc уy хx ѕs іi јj ԁd һh ӏl ԛq ѵv ԝw үy ӕæ әə ԑɛ өɵ ӡʒ "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϜF ͿJ ϺM ϷÞ οo νv ρp ϲc ϳj ϸþ ГΓ ПΠ ФΦ ѰΨ кκ фφ ѱψ µμ"
).split())


def look(text: str) -> str:
    """The canonical form, character by character over the whole text."""
    out = []
    for ch in unicodedata.normalize("NFD", text):
        kind = unicodedata.category(ch)
        if kind == "Cf":
            continue
        if kind == "Zs":
            ch = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            ch = unicodedata.normalize("NFKC", ch)
        out.append(SAME_SHAPE.get(ch, ch))
    return unicodedata.normalize("NFC", "".join(out))


def shared_runs(docs: dict[int, str], items: dict[int, str], n: int = 12) -> set[tuple[int, int]]:
    """(item, document) with n consecutive words in common."""
    grams = defaultdict(set)
    for item, text in items.items():
        w = words(text or "")
        for i in range(len(w) - n + 1):
            grams[tuple(w[i : i + n])].add(item)
    out = set()
    for doc, text in docs.items():
        w = words(text or "")
        for i in range(len(w) - n + 1):
            out |= {(item, doc) for item in grams.get(tuple(w[i : i + n]), ())}
    return out
