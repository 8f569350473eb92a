"""Licence scan by canonical digests.

A text is brought to a canonical form (case, copyright lines, punctuation, white
space and equivalent spellings) and its SHA-256 is looked up among the digests of
known licence texts and notices. Whole documents are hash-joined; the lines of a
document are looked up in the same table, since notices stand on lines of their own.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import require

MAX_KNOWN = 10_000

#: Known licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("Zlib", "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Long licences by identifier, SHA-256 of the canonical form, its length and a
#: word in it. The texts are those of /usr/share/common-licenses of a Debian system, whole
#: and, where they have an appendix, also up to the end of the terms (tests recompute them).
KNOWN_DIGESTS = [
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052", 9859, "representatives"),
    ("Apache-2.0", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793", 8804, "representatives"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93", 5823, "modifications"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361, "redistributions"),
    ("CC0-1.0", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2", 6697, "unconditionally"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd", 19581, "straightforwardly"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd", 22010, "straightforwardly"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", 11762, "responsibilities"),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9", 9412, "responsibilities"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", 17113, "responsibilities"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0", 14479, "responsibilities"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8", 33395, "misrepresentation"),
    ("GPL-3.0", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b", 30957, "misrepresentation"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", 24126, "straightforwardly"),
    ("LGPL-2.0", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389", 22273, "straightforwardly"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", 25213, "straightforwardly"),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97", 23361, "straightforwardly"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104, "distinguishing"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", 22339, "notwithstanding"),
    ("MPL-2.0", "de0e0bad5657ae87b52462bd6dcfbfa29b0e1c9cdb1af2703a8760bce580dd61", 14283, "responsibilities"),

]
#: Short texts are often given without their title.
TITLES = ("MIT License", "ISC License", "Zero-Clause BSD", "BSD 2-Clause License", "BSD 3-Clause License", "zlib License")

#: Equivalent spellings, after punctuation has become space.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("favour", "favor"), ("organisation", "organization"), ("organisations", "organizations"), ("merchantibility", "merchantability"), ("https", "http"), ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("centre", "center"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("v", "version")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright[ \t]+(\(c\)|©|[0-9]|by )|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
_MARKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80), 0xA0, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2026]))
_PUNCTUATION = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F ‘’“”–—…]+"

#: So many words of known texts are searched for before a line is brought to its form.
MAX_WORDS = 64


def canonical_text(text: str) -> str:
    """The canonical form of one text, as the expressions below make it."""
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    text = re.sub(_PUNCTUATION, "  ", re.sub(_COPYRIGHT, "", text))
    text = f" {text} "
    for a, b in SPELLINGS:
        text = text.replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")
    return re.sub(" +", " ", text).strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)" + _COPYRIGHT, "")
    # Case and punctuation in one pass; spaces are doubled so that neighbours have one each.
    out = F.regexp_replace(F.translate(out, _UPPER + _MARKS, _LOWER + " " * len(_MARKS)), " {2,}", " ")
    spaced = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    out = spaced
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    # One search tells whether any spelling is there to be replaced.
    out = F.when(spaced.rlike(f" (?:{'|'.join(a.replace(' ', '  ') for a, _ in SPELLINGS)}) "), out).otherwise(spaced)
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def without_title(text: str) -> str:
    title, _, rest = text.partition("\n\n")
    return rest if title in TITLES else text


def known_forms(known: list[tuple[str, str]], digests: list[tuple[str, str, int, str]]) -> list[tuple[str, str, int, str]]:
    """(licence, digest, length, form or a word of it) of all known texts, with and without title; empty ones are left out."""
    if len(known) + len(digests) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts")
    out = []
    for name, text in known:
        for form in dict.fromkeys([canonical_text(text), canonical_text(without_title(text))]):
            if form:
                out.append((name, hashlib.sha256(form.encode()).hexdigest(), len(form), form))
    return out + list(digests)


def known_digests(known: list[tuple[str, str]], digests: list[tuple[str, str, int, str]]) -> dict[str, str]:
    """Licence by digest; the first of equal texts counts."""
    out: dict[str, str] = {}
    for name, value, _, _ in known_forms(known, digests):
        out.setdefault(value, name)
    return out


def needed_words(forms: set[str]) -> str:
    """A pattern that is in every line with one of these forms: a long word of each, in all its spellings.

    Empty if a form has no such word (all may stem from several words or one letter) or
    if there are too many.
    """
    sources: dict[str, set[str]] = {}
    for a, b in SPELLINGS:
        sources.setdefault(b, {b}).add(a)
    found: set[str] = set()
    for form in forms:
        words = [sources.get(w, {w}) for w in form.split(" ")]
        words = [w for w in words if all(len(x) > 1 and x.isascii() and x.isalnum() for x in w)]
        if not words:
            return ""
        found |= max(words, key=lambda w: (min(map(len, w)), sorted(w)))
    return "(?i)(" + "|".join(sorted(found)) + ")" if len(found) <= MAX_WORDS else ""


def license_scan(documents: DataFrame, text: str = "text", known: list[tuple[str, str]] = KNOWN, keep: list[str] | None = None, known_by_digest: list[tuple[str, str, int, str]] = KNOWN_DIGESTS) -> DataFrame:
    """documents (all columns and rows, or those in keep) with license_digest, license_id and line_licenses.

    license_digest is that of the whole canonical text, null if it is empty (null and
    blank texts, texts of copyright lines only); license_id is the known licence with
    this digest, else null. line_licenses holds the distinct licences, sorted, whose
    whole text is a line of the document. Input columns named like an output are
    replaced; repeated rows are judged alike; an empty table gives an empty result.
    """
    require(documents, text)
    new = ["license_digest", "license_id", "line_licenses"]
    names = [c for c in dict.fromkeys(keep if keep is not None else documents.columns) if c not in new]
    digests = known_digests(known, known_by_digest)
    spark = documents.sparkSession
    source = documents.select(*[documents[c] for c in names], documents[text].alias("__text"))
    form = canonical(F.col("__text"))
    marked = source.withColumn("__form", form).withColumn("license_digest", F.when(F.col("__form") != "", F.sha2("__form", 256)))
    if digests:
        # No bound on a line's length: punctuation, blanks and copyright marks leave no
        # trace in its form. A text of one line has its form already.
        forms_known = known_forms(known, known_by_digest)
        lengths, words = sorted({n for _, _, n, _ in forms_known}), needed_words({f for _, _, _, f in forms_known})
        lookup = F.create_map(*[F.lit(x) for d, n in sorted(digests.items()) for x in (d, n)])
        lines = F.array_distinct(F.split(F.coalesce("__text", F.lit("")), "\n"))
        if words:
            lines = F.filter(lines, lambda x: x.rlike(words))
        every = F.when(F.contains("__text", F.lit("\n")), F.transform(lines, canonical)).otherwise(F.array("__form"))
        forms = F.filter(every, lambda x: F.length(x).isin(lengths))
        found = F.array_sort(F.array_distinct(F.filter(F.transform(forms, lambda x: F.try_element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())))
    else:
        found = F.array().cast("array<string>")
    marked = marked.withColumn("line_licenses", found).drop("__text", "__form")
    table = spark.createDataFrame(sorted(digests.items()) or [("", "")], "license_digest string, license_id string")
    return marked.join(F.broadcast(table), "license_digest", "left").select(*[f"`{c}`" for c in names], *new)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = license_scan(documents, keep=["doc_id"])
    return out.select("doc_id", "license_digest", "license_id", F.array_join("line_licenses", ",").alias("line_licenses"))


def _sql_form(column: str) -> str:
    literal = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"
    out = f"regexp_replace(regexp_replace({out}, {literal(_COPYRIGHT)}, '', 'g'), {literal(_PUNCTUATION)}, '  ', 'g')"
    out = f"(' ' || {out} || ' ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {literal(' ' + a.replace(' ', '  ') + ' ')}, {literal(' ' + b.replace(' ', '  ') + ' ')})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def op3_sql() -> str:
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests(KNOWN, KNOWN_DIGESTS).items()))
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
forms AS (SELECT doc_id, text, {_sql_form("text")} AS form FROM documents),
rows AS (SELECT row_number() OVER () AS r, doc_id, text, CASE WHEN form <> '' THEN sha256(form) END AS license_digest FROM forms),
lines AS (SELECT r, {_sql_form("line")} AS form FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM rows)),
found AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses FROM lines JOIN known ON sha256(lines.form) = known.digest WHERE lines.form <> '' GROUP BY r)
SELECT doc_id, license_digest, license_id, coalesce(line_licenses, '') AS line_licenses
FROM rows LEFT JOIN known ON license_digest = digest LEFT JOIN found USING (r)
"""
