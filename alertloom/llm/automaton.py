"""Levenshtein automata intersected with a lexicon trie.

The automaton of a token accepts every string within k edits of it. Its states are k + 1 bit sets: bit
i of set e says that i characters of the token are matched with e edits. The automaton walks down the
trie of the lexicon, one step per edge, and turns back where no state is left, so a token meets only
the part of the lexicon that is near it. Most tokens do not even get there: of k + 1 pieces of an entry one
is free of k edits, so it stands in the token at its place, shifted by at most k.
"""

from itertools import pairwise



class Node:
    """A trie node: the edges, what ends here, the most edits that an entry below allows."""

    __slots__ = ("below", "ends", "limit")

    def __init__(self):
        self.below: dict[str, Node] = {}
        self.ends: list[tuple[bool, str, float, int]] = []
        self.limit = 0


class Lexicon:
    """A trie of whole words and of stems, which match any word that begins with them."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root = Node()
        for stem, entries in ((False, words), (True, stems)):
            for entry, weight in entries.items():
                node, allowed = self.root, edits(entry, stem)
                node.limit = max(node.limit, allowed)
                for ch in entry:
                    node = node.below.setdefault(ch, Node())
                    node.limit = max(node.limit, allowed)
                node.ends.append((stem, entry, weight, allowed))
        self._front: dict[tuple[int, int], set[str]] = {}
        self._back: dict[int, set[str]] = {}
        for stem, entries in ((False, words), (True, stems)):
            for entry in entries:
                self._note(entry, stem)

    def _note(self, entry: str, stem: bool) -> None:
        k = edits(entry, stem)
        cuts = [len(entry) * i // (k + 1) for i in range(k + 2)]
        for i, (start, end) in enumerate(pairwise(cuts)):
            if i == k and not stem:
                self._back.setdefault(end - start, set()).add(entry[start:end])
                continue
            for shift in range(-k, k + 1) if i else (0,):
                if start + shift >= 0:
                    self._front.setdefault((start + shift, start + shift + end - start), set()).add(entry[start:end])

    def possible(self, token: str) -> bool:
        """False only for tokens that are near no entry."""
        size = len(token)
        for (start, end), pieces in self._front.items():
            if token[start:end] in pieces:
                return True
        for length, pieces in self._back.items():
            if size >= length and token[size - length:] in pieces:
                return True
        return False

    def near(self, token: str) -> list[tuple[str, float, int]]:
        """(entry, weight, edits) of the entries that the token spells, within each entry's edits."""
        most = edits(token, False)
        masks: dict[str, int] = {}
        for i, ch in enumerate(token):
            masks[ch] = masks.get(ch, 0) | 1 << i
        full, found = 1 << len(token), []
        start = tuple((1 << e + 1) - 1 for e in range(most + 1))
        stack = [(self.root, start)]
        while stack:
            node, sets = stack.pop()
            for stem, entry, weight, allowed in node.ends:
                for e, s in enumerate(sets[:allowed + 1]):
                    if s if stem else s & full:
                        found.append((entry, weight, e))
                        break
            for ch, below in node.below.items():
                # Fewer sets where the entries below allow fewer edits.
                after = step(sets[:below.limit + 1], masks.get(ch, 0), full)
                if after[-1]:
                    stack.append((below, after))
        return found


def edits(word: str, stem: bool) -> int:
    """Edits allowed: none up to 4 characters, one up to 8, two beyond; stems need 7 for one."""
    if stem:
        return int(len(word) >= 7)
    return (len(word) > 4) + (len(word) > 8)


def step(sets: tuple[int, ...], mask: int, full: int) -> tuple[int, ...]:
    """The bit sets after one more character of the lexicon, which stands in the token at ``mask``."""
    out, limit, below = [], 2 * full - 1, 0
    for e, s in enumerate(sets):
        now = (s & mask) << 1
        if e:
            # The character is inserted, replaces one of the token, or one of the token is left out.
            now |= sets[e - 1] | sets[e - 1] << 1 | below << 1
        now &= limit
        out.append(now)
        below = now
    return tuple(out)
