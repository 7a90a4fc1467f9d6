"""A xoroshiro128++ stream seeded by splitmix64, as in their published definitions."""

from __future__ import annotations

_M = (1 << 64) - 1


def splitmix64(x: int) -> tuple[int, int]:
    """(next state, output)."""
    x = (x + 0x9E3779B97F4A7C15) & _M
    z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
    return x, z ^ (z >> 31)


class Stream:
    def __init__(self, seed: int):
        state, self.a = splitmix64(seed & _M)
        _, self.b = splitmix64(state)

    def next(self) -> int:
        a, b = self.a, self.b
        s = (a + b) & _M
        out = (((s << 17) | (s >> 47)) + a) & _M
        b ^= a
        self.a = (((a << 49) | (a >> 15)) ^ b ^ (b << 21)) & _M
        self.b = ((b << 28) | (b >> 36)) & _M
        return out

    def below(self, n: int) -> int:
        """A number below n, each as likely as the others (draws beyond a multiple of n are drawn again)."""
        top = (1 << 64) - (1 << 64) % n
        while (x := self.next()) >= top:
            pass
        return x % n

    def unit(self) -> float:
        return (self.next() >> 11) * (1.0 / (1 << 53))


def row_stream(seed: int, name: str) -> Stream:
    """The stream of one row: any row can be drawn on any worker, again and again, with the same result."""
    import xxhash

    return Stream(splitmix64(seed ^ xxhash.xxh64_intdigest(name.encode()))[1])
