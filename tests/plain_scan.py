"""A plain, slow re-statement of the scan on one text, to compare the Spark form with."""

import base64
import hashlib
import math
import re
import unicodedata

from leakscan.functions.normalize import HOMOGLYPHS, ZERO_WIDTH
from leakscan.functions.text import MASK_CHARACTERS, PLACEHOLDER_MARKERS, PUBLIC_EXAMPLES

FOLD = {ord(a): b for src, dst in HOMOGLYPHS for a, b in zip(src, dst)}


def normalize(text):
    for ch in ZERO_WIDTH:
        text = text.replace(ch, "")
    text = unicodedata.normalize("NFKC", text.translate(FOLD))
    parts, used = [], 0
    for run in re.findall(r"[A-Za-z0-9+/=]+", text):
        if len(run) < 16 or len(run) % 4:
            continue
        try:
            raw = base64.b64decode(run, validate=True)
        except ValueError:
            continue
        if not raw or sum(0x20 <= b <= 0x7E for b in raw) / len(raw) < 0.8:
            continue
        used += len(raw) + (1 if parts else 0)
        parts.append(raw.decode("utf-8", "replace"))
    return text + "\n" + "\n".join(parts) if parts else text


def spans(text, regex):
    out = []
    for m in re.finditer(regex.replace(r"\s", r"[\t\n\f\r ]"), text, re.ASCII):
        a = len(text[: m.start()].encode())
        out.append((a, a + len(m.group().encode())))
    return out


def find(canonical, pattern, windowed):
    data = canonical.encode()
    if not pattern.prefix:
        return spans(canonical, pattern.regex)
    low, key, found, at = canonical.lower().encode(), pattern.prefix.lower().encode(), [], 0
    while (pos := low.find(key, at)) >= 0:
        at = pos + len(key)
        if not windowed or len(data) <= 2048:
            found += spans(canonical, pattern.regex)
            continue
        start, end = max(0, pos - 1024), min(len(data), pos + 1024)
        while start < len(data) and data[start] & 0xC0 == 0x80:
            start += 1
        piece = data[start:end].decode("utf-8", "ignore")
        found += [(a + start, b + start) for a, b in spans(piece, pattern.regex)]
    return list(dict.fromkeys(found))


def fold(value):
    return re.sub("[ \t\r\n_-]", "", value).translate({c: c + 32 for c in range(65, 91)})


def placeholder(value):
    if len(value.encode()) < 4:
        return False
    if value.startswith("<") and value.endswith(">") and len(value.encode()) >= 5:
        if re.fullmatch(r"[A-Za-z0-9_\-. ]+", value[1:-1]) and re.search("[A-Za-z]", value[1:-1]):
            return True
    if (value.startswith("{{") and value.endswith("}}")) or (value.startswith("${") and value.endswith("}")):
        return True
    if any(m in value.lower() for m in PLACEHOLDER_MARKERS):
        return True
    bare = [c for c in value if c not in " -_\t."]
    return len(bare) >= 6 and len(set(bare)) == 1 and (
        bare[0] in MASK_CHARACTERS or unicodedata.category(bare[0])[0] in "PS" or unicodedata.category(bare[0]) == "Cc"
    )


def entropy(value):
    data = value.encode()
    h = 0.0
    for b in sorted(set(data)):
        p = data.count(b) / len(data)
        h -= p * math.log2(p)
    return h


def scan(text, rules, config, windowed=False, source=None, allowed=lambda value: False, prior=""):
    canonical = normalize(text)
    if prior:
        canonical = prior + "\n" + canonical
    data = canonical.encode()
    best = None
    for p in rules.patterns:
        found = find(canonical, p, windowed)
        if not found or (p.min_matches > 0 and len(found) < p.min_matches):
            continue
        top, hot_seen = None, False
        for a, b in found:
            value = data[a:b].decode()
            if hashlib.sha256(fold(value).encode()).hexdigest() in PUBLIC_EXAMPLES or placeholder(value) or allowed(value):
                continue
            w = p.hotword_window
            hot = w > 0 and any(
                h.strip().lower().encode() in side.lower()
                for h in p.hotwords
                for side in (data[max(0, a - w) : a], data[b : b + w])
            )
            hit = suppress = False
            for x in rules.exclusions:
                if not x.applies(p.name):
                    continue
                if x.type == "regex":
                    if re.search(x.pattern, value):
                        hit, suppress = True, suppress or x.suppress
                elif x.match_type == "exact":
                    if any(word.strip().lower() == value.lower() for word in x.words):
                        suppress = True
                else:
                    win = x.window or 50
                    hay = data[max(0, a - win) : b + win].decode("utf-8", "replace").lower().replace(value.lower(), "", 1)
                    hit = hit or any(word.strip().lower() in hay for word in x.words)
            if suppress:
                continue
            score = p.score_weight if p.score_weight > 0 else 1
            if hot:
                score += p.hotword_boost or config.hotword_boost
            if p.entropy_min > 0:
                score += config.entropy_boost if entropy(value) >= p.entropy_min else config.entropy_penalty
            score += config.multi_match_boost * min(len(found) - 1, 5)
            if hit:
                score += config.exclusion_penalty
            top = score if top is None else max(top, score)
            hot_seen = hot_seen or hot
        if top is None or (p.require_hotword and not hot_seen):
            continue
        top += bias(p, source) if source else 0
        limit = getattr(config, f"threshold_{p.severity}", config.threshold_low)
        if top >= limit and (best is None or (-top, p.name) < (-best[1], best[0])):
            best = (p.name, top)
    return (True, *best) if best else (False, "", 0)


def bias(p, s):
    kind = s.get("destination_kind", "")
    total = 0
    if kind:
        total += (p.context_bias or {}).get(kind, -2 if kind == "code_host" else 0)
    total += s.get("element_kind") == "network_body"
    total -= bool(s.get("in_code_fence")) and p.severity in ("medium", "low")
    total -= s.get("language_hint", "").strip().lower() in ("test", "fixture", "spec")
    total -= kind == "code_host" and s.get("path_hint", "").strip().lower() in ("test", "fixture", "spec", "mock")
    return total
