"""DuckDB SQL for the queries of this subpackage that SQL can express, by name.

The others need XXH64, a tokenizer, a model or FLAC, which DuckDB hasn't; they are tested against brute force instead.
"""


def _crc_table() -> str:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return f"[{','.join(out)}]::BIGINT[]"


op1_byte_shards = f"""
WITH t AS (SELECT {_crc_table()} AS crc), d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, t),
s AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w - 1 AS place FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least(23, ((2 * upto - size) * 24) // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""


def _escaped(column: str) -> str:
    column = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in ("<s>", "</s>", "[INST]", "[/INST]"):
        column = f"replace({column}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return column


op10_chat_paths = f"""
WITH own AS (SELECT -1 AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, '</s>[INST] ok [/INST]' AS text),
m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
string_agg('<s>[INST] ' || {_escaped("role")} || ' [/INST] ' || {_escaped("text")} || '</s>', '' ORDER BY turn, role, text) AS formatted FROM m GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, length(formatted) AS formatted_chars FROM g
"""
