"""License scans by canonical digest.

A text is brought to a canonical form: lower case, copyright notices dropped (also those that go on on the next lines), the marks of listed
items dropped (a number or letter that begins a sentence), equivalent spellings made one, every run of other characters than letters and
digits one space, and the owner that a BSD licence names replaced by "the copyright owner". Its digest is hash-joined to the digests of known licence texts. The join is on
entire texts: a licence with anything beside it but copyright lines is another text, so a licence under one of its usual titles is
known as a text of its own. Where a licence begins on the line of a copyright notice, only the notice before it goes.

The built-in catalogue holds short licences and notices as texts, and long licences as digests of their canonical forms, with and without what
follows their terms. Others come from a folder of text files, each named by its licence: see known().

Defined cases: a null or empty text has the digest of the empty string and no licence; repeated rows and ids are rows of their own;
texts of any length count whole; other columns of the documents play no part; an empty table gives an empty result; two known texts
with one canonical form count as the first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm.common import table

#: Spellings that count as one, in the order in which they are replaced.
SPELLINGS = {
    "licence": "license",
    "sublicence": "sublicense",
    "organisation": "organization",
    "favour": "favor",
    "whilst": "while",
    "non infringement": "noninfringement",
    "non commercial": "noncommercial",
    "copyright holders": "copyright owners",
    "copyright holder": "copyright owner",
    "https": "http",
}
#: Lines that begin with a notice, not those that a wrapped sentence on copyright begins.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright[^a-z0-9\n]*(\(c\)|©|[0-9]|by |year|yyyy)|\(c\)[^a-z\n]*[0-9]|©|all rights reserved)([^\n]*(,| and| &)[ \t\r]*\n){0,3}[^\n]*(\n[^\n]{0,60}all rights reserved[.]?)?"
#: The number or letter of a listed item.
MARK = r"(^|[.:;][ \t\r\n])[ \t\r\n]*[(]?([0-9]{1,2}|[a-z])[.)][ \t\r\n]+"
#: Words with which a licence begins, also behind a copyright notice on one line.
OPENING = r"[.,;:]?[ \t]+(permission is hereby granted|permission to use|redistribution and use in|this is free and unencumbered|this software is provided|licensed under the|released under the|everyone is permitted to copy)"
OTHER = r"[^\p{L}\p{N}]+"
#: Where BSD licences name their owner, in canonical form with the spellings replaced, and what stands for it.
OWNERS = {
    r"neither the names? of ([^ ]+ ){1,12}?nor the names of (its|their|any|the) contributors may": "neither the name of the copyright owner nor the names of its contributors may",
    r"this software is provided by ([^ ]+ ){1,12}?as is and any express or implied": "this software is provided by the copyright owners and contributors as is and any express or implied",
    r"in no event shall ([^ ]+ ){1,12}?be liable for any direct indirect": "in no event shall the copyright owner or contributors be liable for any direct indirect",
}
#: Public licence texts by SPDX name.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}
#: Titles above whole texts.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"],
    "ISC": ["ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "MIT License (MIT)"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
#: The notices by which a work commonly names its licence.
NOTICES = {
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT notice": "Released under the MIT License.",
}
#: Digests of the canonical forms of long licences by SPDX name, whole and up to the end of their terms.
DIGESTS = {
    "Apache-2.0": ["f8f711704feac48f43eb125ca96dab17a1da5da3343ff1ea06eb7bfae9fb5649", "01bd11c103c65e5db56ce884b600e5986dd03ac5fd8ec02792d3c857e6049a7c", "f5156b991895d728154c9ade7edeea767876ff959f2eceb671088da28cc2228f"],
    "Artistic-1.0-Perl": ["13caa6a0bc52f01d305d07b8139a4750d73ad358309326b68cc4acee2a5d977f"],
    "CC0-1.0": ["888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c"],
    "GFDL-1.2": ["15df8a529ab79bc230064b956bb839af7f52ae093f89975ea7bb6b6b85e13837"],
    "GFDL-1.3": ["817b3e2ffeff4d1d86f791fcc78b347422336b431213fec5042646cbd10706cf"],
    "GPL-1.0": ["9bd6429021cd636c349c83379fdef559038e2c6021f66f9bfb8daf85948e3a87", "91421d857c2710a9f854c6c9137d99b12958fb2437c14a4592ae115a1e6d6184", "54818b933b615688873640d8495acd86e0f380c3df483567810a679d46a2f9f4"],
    "GPL-2.0": ["45dc1aa9fb29dbea40bb1e5300d681bc7989993269c8a0703f69ac05fe4aed95", "d557ce8a15b04ab33f5849eef31547fe9bec4addc68cdbf73db8ed56d61e354a", "d1425302c1d77d2a1aba73355ce9cbef23da949d72939e8a6f8fdf6d5602b34f"],
    "GPL-3.0": ["975612af291d7f831b0ea0e677694ac5f4471a676949fa694c64a5ffd12c4df8", "109a584b4a2b9b32466659591a7dd2f94d033514b2e83c61c2c8e3bcbc9f87e7", "e2994823216ce29dfed3c676875a37ac1b22eae3a3ae9b5658d7f11a0faee0de"],
    "LGPL-2.0": ["1ce3085d176edcdb4da8ed5d2e8c069c223d3e0cad570fbcef2af8ebec427b53", "f9aedaf5e9e827e606cabbdb93e21eb8318a79df2070bdc1d8324818dec39e71", "838792b5d10b49348dab8d613006a486485eaba90201931f6cfe65f968d7af48"],
    "LGPL-2.1": ["bd130132f606844236538722b8790431238f06ddb43547eaab32f90e020ea3e4", "c36716c169466306f11effe609ad155880e2ba709e5ecd69ddbf4dc55f0bb0f6", "5c0b2bc69bf484ef9e1ab06da616c768dea82a3989f519db9ecbec2919854c6e"],
    "LGPL-3.0": ["accac2eda9011d3f3018b6a6b669c6507d103d98c2d5e8ba84daf721525af49f"],
    "MPL-1.1": ["224f2906f115e7f2d9fc5efb3b3b7937778680e692df5a02913de1e1cda04c23"],
    "MPL-2.0": ["36c5079e7ac2a6449dc3f6867324e73bd542443cbfff8cb72d2654c87b483d24"],
}


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, F.lit(OPENING), F.lit("\n$1"))
    out = F.regexp_replace(out, F.lit(COPYRIGHT_LINE), F.lit("\n"))
    out = F.regexp_replace(out, F.lit(MARK), F.lit("$1 "))
    out = F.trim(F.regexp_replace(out, F.lit(OTHER), F.lit(" ")))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in OWNERS.items():
        out = F.regexp_replace(out, F.lit(a), F.lit(b))
    return out


def digests(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"))


def catalogue() -> list[tuple[str, str]]:
    """licence and text: whole texts, plain and under each title, and notices."""
    titled = {(name, f"{the}{title}") for name, titles in TITLES.items() for title in titles for the in ("", "The ")}
    return sorted([*KNOWN.items(), *NOTICES.items()] + [(name, f"{title}\n\n{KNOWN[name]}") for name, title in titled])


def known(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """license, digest, one row per digest. The built-in texts and digests, and the texts of a folder's files, named by their licences, such as
    Apache-2.0.txt."""
    texts = spark.createDataFrame(catalogue(), "license string, text string")
    if folder:
        name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(txt|md)$", "")
        texts = texts.unionByName(spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("license"), F.col("value").alias("text")))
    found = digests(texts, "license").unionByName(spark.createDataFrame([(name, d) for name, ds in DIGESTS.items() for d in ds], "license string, digest string"))
    return found.groupBy("digest").agg(F.min("license").alias("license"))


def scanned(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """doc_id, digest, license (null: none known). Spark broadcasts the catalogue only if its size is under its threshold."""
    return digests(docs, "doc_id").join(catalogue, "digest", "left").select("doc_id", "digest", "license")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"), known(spark))


def op9_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), {quoted(OPENING)}, chr(10) || '\\1', 'g')"
        out = f"regexp_replace({out}, {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        out = f"regexp_replace({out}, {quoted(MARK)}, '\\1 ', 'g')"
        out = f"trim(regexp_replace({out}, {quoted(OTHER)}, ' ', 'g'))"
        for a, b in SPELLINGS.items():
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        for a, b in OWNERS.items():
            out = f"regexp_replace({out}, {quoted(a)}, {quoted(b)}, 'g')"
        return f"sha256({out})"

    rows = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in catalogue())
    more = ", ".join(f"({quoted(name)}, {quoted(d)})" for name, ds in DIGESTS.items() for d in ds)
    return (
        f"WITH texts(license, text) AS (VALUES {rows}), more(license, digest) AS (VALUES {more}), "
        f"known AS (SELECT digest, min(license) AS license FROM (SELECT license, {form('text')} AS digest FROM texts UNION ALL SELECT license, digest FROM more) GROUP BY 1), "
        f"scanned AS (SELECT doc_id, {form('text')} AS digest FROM documents) "
        "SELECT doc_id, scanned.digest AS digest, license FROM scanned LEFT JOIN known ON scanned.digest = known.digest"
    )
