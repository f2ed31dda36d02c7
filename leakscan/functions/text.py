"""Small text functions: byte slices, case folding, hashes, entropy, value shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leakscan.functions.arrays import constant, let

# SHA-256 of well-known published example values, after
# ``normalize_value``. Only digests are kept.
PUBLIC_EXAMPLES = (
    # cloud documentation keys
    "2eb6c6020c2290c8d9020b570bd9d6ef7577109b2d51c2510b61674ca782ee18",
    "9b4d1fe07ab0b901c8c549a3431f4cd95ffb0149cbbbd41a37026098e0a857c0",
    "fcc070589dd4e6aebb0419707762410c066860353dd1a2a6d3dab1775c0c36b0",
    # payment test keys
    "812992bb0cd8301ed7ec407e312ef1ffefa413fb39b7b5ea29715efbe557a784",
    "81725703670b0b981181748791820f26997d3ac56e1dbc508ca3152d2e959694",
    "bf90d859b5cf18b9c2edd0572e93be3ba8617d42f11b38f9a08c3d8e16fc067d",
    "d4f3b9b9662f8683b74a505a9692a32847846d49106a13173c1acb14b4240241",
    # test card numbers
    "9bbef19476623ca56c17da75fd57734dbf82530686043a6e491c6d71befe8f6e",
    "477bba133c182267fe5f086924abdc5db71f77bfc27f01f2843f2cdc69d89f05",
    "dd13cdf9af9dd3baf46ce96aecd7163cabf381ccb21e63f15f0fa10b1c663fa9",
    "2f725bbd1f405a1ed0336abaf85ddfeb6902a9984a76fd877c3b5cc3b5085a82",
    "304945e91de3deff52a61d08733141d72dd42ec9d47972f1060534d54c0c7f90",
    "3a134ef77d4e2e4cdad2d2945ff1f76c1a23296c93c851f6244220a8cedea130",
    "53a8fc816e63b7a5ccd17aaff93f28bcf13abbf418209dcd93947722d7c326ba",
    "19ff47cc8024c133d5845d3f8938caca289929031e7d508c3adf7adff177f0c2",
    "51a4ae4c6ae999146474a67cbcb3b05fbcf4c17ab683043a066459da95513ea8",
    "1c9d38ed26cd808fa3b02b9b3b988a7caf474e2e42d95789c0fe07e267c80d8f",
    # social-security placeholders
    "f120bb5698d520c5691b6d603a00bfd662d13bf177a04571f9d10c0745dfa2a5",
    "1a5376ad727d65213a79f3108541cf95012969a0d3064f108b5dd6e7f8c19b89",
    "15e2b0d3c33891ebb0f1ef609ec419420c20e320ce94c65fbc8c3312448eb225",
    "8a9bcf1e51e812d0af8465a8dbcc9f741064bf0af3b3d08e6b0246437c19f7fb",
    # documentation UUIDs
    "84e0c0eafaa95a34c293f278ac52e45ce537bab5e752a00e6959a13ae103b65a",
    "140f39b05a2d9de451b9b7ad2d1f4a26b16fb5e5c8b7cbde6154679102614882",
    "8a83665f3798727f14f92ad0e6c99fdab08ee731d6cd644c131223fd2f4fed2a",
    "352302489bc2fcf025cf00cda8308033f97ac87712ce90b4d7cd72c58e4c3af9",
    "f61cf167454b8f32635f585ae94699fc670a44bca48d6350a4361bca1752ab0b",
    # example web token and token masks
    "4de2692a4f508164d09c5aa954d9d965d9f5ed47b0551b1b7cebdf7384ba4411",
    "d804c5614dcc743c75e4863b8bf47775bbdb724205d02771d8ff27802a40a053",
    "c83e4aa7782ef61c65f0e467b61ad55645c6b59f1cc0e103213393c702b4b41f",
)

# Substrings that mark a value as a template.
PLACEHOLDER_MARKERS = (
    "your_", "your-", "yourkey", "your.key",
    "insert_", "insert-",
    "replace_", "replace-",
    "example_", "example-", "_example",
    "_here", "-here",
    "placeholder",
    "todo_", "todo-", "_todo",
    "fixme",
    "sample_", "sample-",
    "dummy_", "dummy-",
    "my_secret", "my-secret",
    "redacted",
)

# Characters used to mask a value.
MASK_CHARACTERS = "xXoO*#●•⋆⁂_"


def fold_case(text: Column) -> Column:
    """Per-character lower case.

    Java lowers two letters by context or to two characters; both are replaced
    first so that every character folds on its own.
    """
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary as text; a character cut at an edge becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(data, start + 1, end - start).cast("string"))


def byte_view(text: Column) -> Column:
    """The text with one character per UTF-8 byte."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(
        F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    )


def remove_first(text: Column, part: Column) -> Column:
    def cut(at: Column) -> Column:
        return F.when((part == "") | (at == 0), text).otherwise(
            F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))
        )

    return let(F.position(part, text), cut)


def normalize_value(value: Column) -> Column:
    """Separators dropped and ASCII letters lowered, so that spellings of one value agree."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(value, upper + " \t\n\r-_", upper.lower())


def value_digest(value: Column) -> Column:
    return F.sha2(normalize_value(value).cast("binary"), 256)


def salted_digest(value: Column, salt: str | bytes) -> Column:
    salt_bytes = salt.encode() if isinstance(salt, str) else salt
    return F.sha2(F.concat(F.lit(salt_bytes), normalize_value(value).cast("binary")), 256)


def is_public_example(value: Column) -> Column:
    return (value != "") & F.array_contains(constant(PUBLIC_EXAMPLES), value_digest(value))


def is_placeholder_shape(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    template = (
        value.startswith("<") & value.endswith(">") & (F.octet_length(value) >= 5)
        & inner.rlike(r"\A[A-Za-z0-9_\-. ]+\z") & inner.rlike("[A-Za-z]")
    )
    interpolated = (value.startswith("{{") & value.endswith("}}")) | (value.startswith("${") & value.endswith("}"))
    marked = let(fold_case(value), lambda low: F.exists(constant(PLACEHOLDER_MARKERS), lambda m: F.contains(low, m)))

    def one_mask(bare: Column) -> Column:
        first = F.substring(bare, 1, 1)
        mask = F.contains(F.lit(MASK_CHARACTERS), first) | first.rlike(r"[\p{Cc}\p{P}\p{S}]")
        return (F.length(bare) >= 6) & (F.replace(bare, first, F.lit("")) == "") & mask

    masked = let(F.translate(value, " -_\t.", ""), one_mask)
    return (F.octet_length(value) >= 4) & (template | interpolated | marked | masked)


def shannon_entropy(value: Column) -> Column:
    """Bits per byte; terms are added in byte order so that sums are reproducible."""

    def entropy(view: Column) -> Column:
        total = F.length(view).cast("double")

        def term(acc: Column, ch: Column) -> Column:
            share = (total - F.length(F.replace(view, ch, F.lit("")))) / total
            return acc - share * F.log2(share)

        symbols = F.array_sort(F.array_distinct(F.filter(F.split(view, ""), lambda c: c != "")))
        return F.aggregate(symbols, F.lit(0.0), term)

    return F.when(value == "", F.lit(0.0)).otherwise(let(byte_view(value), entropy))


def byte_tail(text: Column, size: int) -> Column:
    """The last ``size`` bytes of a text, less the rest of a character cut at the front."""
    data = text.cast("binary")
    cut = F.substring(data, F.greatest(F.octet_length(text) - size, F.lit(0)) + 1, F.lit(size))
    whole = F.regexp_replace(F.hex(cut), "^(?:[89AB][0-9A-F]){1,3}", "")
    return F.when(F.octet_length(text) <= size, text).otherwise(F.unhex(whole).cast("string"))
