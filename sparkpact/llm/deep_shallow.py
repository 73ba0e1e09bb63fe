"""Deep-shallow string sorting: multikey quicksort to a shallow depth, then blind tries for what is still alike there."""

from __future__ import annotations


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, at least ``known``."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A trie that stores only branching depths and characters; each insertion compares with one stored string."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth, self.root = strings, depth, None

    def _at(self, k: int, depth: int) -> int:
        s = self.strings[k]
        return s[depth] if depth < len(s) else -1

    def insert(self, k: int) -> None:
        if self.root is None:
            self.root = (None, [k])
            return
        node, path = self.root, []
        while node[0] is not None:  # blind descent: only branching characters are looked at
            path.append(node)
            children = node[1]
            node = children.get(self._at(k, node[0])) or next(iter(children.values()))
        leaf = node
        same = common_prefix(self.strings[k], self.strings[leaf[1][0]], self.depth)
        if same == len(self.strings[k]) == len(self.strings[leaf[1][0]]):
            leaf[1].append(k)
            return
        above = None
        node = self.root
        for node in [*path, leaf]:
            if node[0] is None or node[0] >= same:
                break
            above = node
        if node[0] == same:
            node[1][self._at(k, same)] = (None, [k])
            return
        other = self._at(leaf[1][0], same)
        fork = (same, {other: node, self._at(k, same): (None, [k])})
        if above is None:
            self.root = fork
        else:
            above[1][self._at(k, above[0])] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            depth, below = stack.pop()
            if depth is None:
                out += below
            else:
                stack += [below[c] for c in sorted(below, reverse=True)]
        return out


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = 12) -> tuple[list[int], list[int]]:
    """The sorted order of strings that agree on their first ``depth`` bytes, and each one's common prefix with the one before (0 first)."""
    order: list[int] = []
    stack = [([*range(len(strings))], depth)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            order += group
        elif at >= depth + shallow:
            trie = BlindTrie(strings, at)
            for k in group:
                trie.insert(k)
            order += trie.order()
        else:
            head = [s[at] if at < len(s) else -1 for s in map(strings.__getitem__, group)]
            pivot = sorted((head[0], head[len(head) // 2], head[-1]))[1]
            less, same, more = [], [], []
            for k, c in zip(group, head, strict=True):
                (same if c == pivot else less if c < pivot else more).append(k)
            if more:
                stack.append((more, at))
            if pivot == -1:
                # ended strings are alike
                stack.append((same[:1], at))
                for k in same[1:]:
                    stack.append(([k], at))
            else:
                stack.append((same, at + 1))
            if less:
                stack.append((less, at))
    prefixes = [0] * len(order)
    for i in range(1, len(order)):
        prefixes[i] = common_prefix(strings[order[i - 1]], strings[order[i]], depth)
    return order, prefixes
