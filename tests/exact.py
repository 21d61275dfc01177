"""The main tokenizer as a scan over single characters, to compare with."""

import unicodedata

from lingmill.functions.chars import IN_WORD, SEPARATING_SYMBOLS, upper_py
from lingmill.functions.urls import UrlRules, find_urls, is_letter, is_punctuation, is_white


def tokens_exact(text: str, rules: UrlRules) -> list[str]:
    t = text.split("\0", 1)[0]
    urls = find_urls(t, rules)
    out: list[str] = []

    def digitlike(c: str) -> bool:
        return unicodedata.category(c) == "Nd" and c <= "￿" or c in ";,:./\\- –〃´°"

    def edge(c: str) -> bool:
        return is_letter(c) or (unicodedata.category(c) == "Nd" and c <= "￿")

    def word(a: int, b: int, check: bool) -> None:
        if a >= b or (check and all(digitlike(c) for c in t[a:b]) and b < len(t) and digitlike(t[b])):
            return
        x, y = a, b
        while x < b and not edge(t[x]):
            x += 1
        while y - 1 > x and not edge(t[y - 1]):
            y -= 1
        if (x, y) != (a, b) and y - x <= 1:
            return
        out.append("".join(upper_py(c) if c <= "￿" else c for c in t[x:y]))

    start = i = k = 0
    while i < len(t):
        if k < len(urls) and urls[k][0] <= i:
            word(start, i, True)
            start = i = max(urls[k][1], i)
            k += 1
            continue
        separator = t[i] in SEPARATING_SYMBOLS or (is_punctuation(t[i]) and t[i] not in IN_WORD)
        if is_white(t[i]):
            word(start, i, True)
            start = i + 1
        elif separator:
            word(start, i, False)
            i += 1
            while i < len(t) and (is_white(t[i]) or is_punctuation(t[i])):
                i += 1
            start = i
            continue
        i += 1
    word(start, len(t), True)
    return out
