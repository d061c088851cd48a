"""SQL twins of hashes that the engine of the oracle lacks."""


def crc_steps() -> list[int]:
    """What the low four bits of a CRC-32 become when they are shifted out."""
    steps = list(range(16))
    for _ in range(4):
        steps = [(x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1 for x in steps]
    return steps


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    nibbles = f"list_transform(range(0, 2 * strlen({text})), lambda k: instr('123456789ABCDEF', substr(hex(encode({text})), (k + 2 - 2 * (k % 2))::INT, 1))::BIGINT)"
    return f"xor(list_reduce({nibbles}, lambda c, b: xor(c >> 4, ({crc_steps()}::BIGINT[])[(xor(c, b) & 15) + 1]), 4294967295::BIGINT), 4294967295)"
