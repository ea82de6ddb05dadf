"""BLAKE3 (256-bit hash mode) from its public specification: of one input, or of many short ones at once over numpy arrays."""

from __future__ import annotations

import numpy as np

#: The initial state and the message permutation of the specification.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF
_ROUND = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv, block: bytes, counter: int, length: int, flags: int) -> tuple[int, ...]:
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*cv, *_IV[:4], counter & _MASK, counter >> 32, length, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_ROUND):
            for word, far, near in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & _MASK
                x = v[d] ^ v[a]
                v[d] = (x >> far | x << (32 - far)) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                x = v[b] ^ v[c]
                v[b] = (x >> near | x << (32 - near)) & _MASK
        m = [m[i] for i in _PERMUTATION]
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def _chunk(data: bytes, counter: int, root: bool) -> tuple[int, ...]:
    cv, blocks = _IV, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, block in enumerate(blocks):
        last = i == len(blocks) - 1
        flags = (_CHUNK_START if i == 0 else 0) | (_CHUNK_END if last else 0) | (_ROOT if last and root else 0)
        cv = _compress(cv, block.ljust(64, b"\0"), counter, len(block), flags)
    return cv


def _tree(data: bytes, first: int, root: bool) -> tuple[int, ...]:
    chunks = max(1, -(-len(data) // 1024))
    if chunks == 1:
        return _chunk(data, first, root)
    left = 1 << (chunks - 1).bit_length() - 1  # the greatest power of two below the number of chunks
    halves = [_tree(data[: left * 1024], first, False), _tree(data[left * 1024 :], first + left, False)]
    block = b"".join(x.to_bytes(4, "little") for h in halves for x in h)
    return _compress(_IV, block, 0, 64, _PARENT | (_ROOT if root else 0))


def blake3(data: bytes) -> bytes:
    return b"".join(x.to_bytes(4, "little") for x in _tree(data, 0, True))


#: Inputs hashed at once, so that their words stay in the processor's cache.
AT_ONCE = 4096


def blake3_many(inputs: list[bytes]) -> list[bytes]:
    """Hashes of many inputs. Those of one chunk (1024 bytes) go through the rounds together, by their number of blocks; longer ones one by one."""
    out: list[bytes] = [b""] * len(inputs)
    size = np.fromiter(map(len, inputs), np.int64, len(inputs))
    blocks = np.maximum(1, -(-size // 64))
    for i in np.flatnonzero(blocks > 16).tolist():
        out[i] = blake3(inputs[i])
    for n in np.unique(blocks[blocks <= 16]).tolist():
        some = np.flatnonzero(blocks == n)
        for lo in range(0, len(some), AT_ONCE):
            at = some[lo : lo + AT_ONCE].tolist()
            raw = np.frombuffer(b"".join(inputs[i].ljust(64 * n, b"\0") for i in at), "<u4").reshape(len(at), n, 16)
            digests = _one_chunk(raw, size[some[lo : lo + AT_ONCE]]).tobytes()
            for k, i in enumerate(at):
                out[i] = digests[32 * k : 32 * k + 32]
    return out


def _one_chunk(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of 8 words for inputs (rows of ``words``) of equally many blocks."""
    count, n, _ = words.shape
    cv = [np.full(count, x, np.uint32) for x in _IV]
    for i in range(n):
        last = i == n - 1
        flags = (_CHUNK_START if i == 0 else 0) | ((_CHUNK_END | _ROOT) if last else 0)
        length = (size - 64 * i if last else np.full(count, 64)).astype(np.uint32)
        m = [np.ascontiguousarray(words[:, i, k]) for k in range(16)]
        zero = np.zeros(count, np.uint32)
        v = [*[c.copy() for c in cv], *[np.full(count, x, np.uint32) for x in _IV[:4]], zero, zero.copy(), length, np.full(count, flags, np.uint32)]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(_ROUND):
                for word, far, near in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] += v[b]
                    v[a] += word
                    v[d] ^= v[a]
                    v[d] = (v[d] >> np.uint32(far)) | (v[d] << np.uint32(32 - far))
                    v[c] += v[d]
                    v[b] ^= v[c]
                    v[b] = (v[b] >> np.uint32(near)) | (v[b] << np.uint32(32 - near))
            m = [m[j] for j in _PERMUTATION]
        cv = [v[j] ^ v[j + 8] for j in range(8)]
    return np.stack(cv, axis=1).astype("<u4")
