import re

import pytest

import rows as R
from chartspark.llm import book, licenses

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def plain(text):
    """Identifiers, licences and open identifiers by ordinary code, for texts without pieces of sentences."""
    names = []
    lines = []
    for line in text.split("\n"):
        line = re.sub(r"^[ \t]*(#+|//+|/\*+|\*+/|\*+|--+|;+|%+|>+)[ \t]*", "", line)
        lines.append(re.sub(r"(?i)^[ \t]*copyright \(c\) [0-9]{4}[^.;:!?]*", "\n\n", line))
    text = "\n".join(lines)
    norm = lambda s: re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c.isascii() else c for c in s)).strip(" ")
    for sentence in re.split(licenses.SENTENCE_END, text):
        if norm(sentence) in licenses.SENTENCES:
            names.append(licenses.SENTENCES[norm(sentence)])
        else:
            names += [licenses.SENTENCES.get(norm(line)) for line in sentence.split("\n") if not re.fullmatch("[0-9]*", norm(line))]
    read = "".join("~" if n is None else f"[{n}]" for n in names)
    for licence, parts in licenses.RULES:
        read = read.replace("".join(f"[{p}]" for p in parts), "{" + licence + "}")
    return [n for n in names if n], re.findall(r"\{([^}]*)\}", read), re.findall(r"\[([^\]]*)\]", read)


def test_every_sentence_is_normalised_and_holds_a_hint():
    pattern = re.compile(licenses.hint_pattern(licenses.SENTENCES))
    for sentence in licenses.SENTENCES:
        assert sentence == re.sub("[^a-z0-9]+", " ", sentence).strip() and pattern.search(sentence.upper())
    known = set(licenses.SENTENCES.values())
    assert all(set(parts) <= known for _, parts in licenses.RULES)


def test_a_table_with_other_words_finds_its_own_hints(spark):
    own = {"use it as you like": "free"}
    found = licenses.scan(R.documents(spark, ["Use it, as you like!"]), sentences=own, rules=(("Free", ("free",)),)).collect()
    assert found[0].licenses == ["Free"]


def test_sentences_rules_and_edges(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at: x"
    texts = [MIT, apache, None, "", "no words of that kind", "All rights reserved. LICENSED under CC BY-NC 4.0.*** Released under the MIT License", "You may obtain a copy of the license at", "ab " * 200_000 + ". Licensed under CC BY 4.0.\n", MIT + "\n" + MIT]
    found = licenses.scan(R.clashing(R.documents(spark, texts))).orderBy("doc_id").collect()
    assert [(r.sentences, r.licenses, r.open) for r in found] == [plain(t or "") for t in texts]
    assert found[0].licenses == ["MIT"] and found[0].sentences == ["mit.title", "mit.grant", "mit.notice"]
    assert found[1].licenses == ["Apache-2.0"] and found[5].licenses == ["Proprietary", "CC-BY-NC-4.0", "MIT"] and found[6].open == ["apache2.copy"]


def test_repeated_rows_and_null_ids_and_empty_table(spark):
    docs = R.documents(spark, ["Released under the MIT License."] * 3, ids=[None, 1, 1])
    assert [r.licenses for r in licenses.scan(docs).collect()] == [["MIT"]] * 3
    assert licenses.scan(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    text = book.op1_license_sentences(spark, R.SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", text)


@pytest.mark.parametrize("text", ["a.b. c", "..", "\n\n\n", "licensed\nunder"])
def test_odd_spacing(spark, text):
    found = licenses.scan(R.documents(spark, [text])).first()
    assert (found.sentences, found.licenses, found.open) == plain(text)


GPL = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_official_texts(spark):
    texts = [GPL.format(";", ";", 2), GPL.format(":", ",", 3), GPL.format(",", ";", 2), BSD, BSD + ENDORSE, APACHE, MPL, "This program is free software; licensed under it."]
    found = licenses.scan(R.documents(spark, texts)).orderBy("doc_id").collect()
    gpl2, gpl3 = ["gpl2.grant", "gpl.warranty", "gpl.see"], ["gpl3.grant", "gpl.warranty", "gpl.see"]
    assert [r.licenses for r in found] == [["GPL-2.0-or-later"], ["GPL-3.0-or-later"], ["GPL-2.0-or-later"], ["BSD-2-Clause"], ["BSD-3-Clause"], ["Apache-2.0"], ["MPL-2.0"], []]
    assert [r.sentences for r in found[:3]] == [gpl2, gpl3, gpl2] and found[7].sentences == [] and not any(r.open for r in found)


MIT_WHOLE = MIT + """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Copyright 2020 J. Doe, Some Inc. and others

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
RESERVED = BSD.replace("Some Body\n", "Some Body. All rights reserved.\n")
#: How an official text stands in files.
FORMS = {
    "as it is": lambda t: t, "hash": lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()), "slashes": lambda t: "".join(f"// {x}\n" for x in t.splitlines()),
    "block": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\nint main() {}\n", "one line a paragraph": lambda t: "\n\n".join(p.replace("\n", " ") for p in t.split("\n\n")),
}
OFFICIAL = {
    "MIT": [MIT, MIT_WHOLE], "ISC": [ISC], "BSD-2-Clause": [BSD, BSD + BSD_END, RESERVED + BSD_END], "BSD-3-Clause": [BSD + ENDORSE, BSD + ENDORSE + BSD_END, RESERVED + ENDORSE + BSD_END],
    "Apache-2.0": ["Copyright 2020 Some Body\n\n" + APACHE], "GPL-2.0-or-later": [GPL.format(";", ";", 2)], "GPL-3.0-or-later": [GPL.format(":", ",", 3)], "MPL-2.0": [MPL],
}


@pytest.mark.parametrize("form", FORMS)
def test_official_texts_as_they_stand_in_files(spark, form):
    cases = [(name, text) for name, texts in OFFICIAL.items() for text in texts]
    found = licenses.scan(R.documents(spark, [FORMS[form](t) for _, t in cases])).orderBy("doc_id").collect()
    assert [(r.licenses, r.open) for r in found] == [([name], []) for name, _ in cases]


def test_claims_behind_a_copyright_line_stay(spark):
    texts = ["Copyright 2020 IBM. Licensed under CC BY 4.0.\n", "Copyright laws apply. Licensed under CC BY 4.0.\n", "copyright 2020 " + "a b" * 500_000, "(c) 1999 A. B. C. Licensed under the MIT License\n"]
    assert [r.licenses for r in licenses.scan(R.documents(spark, texts)).orderBy("doc_id").collect()] == [["CC-BY-4.0"], ["CC-BY-4.0"], [], ["MIT"]]


def test_twin_on_official_texts(spark, tmp_path):
    import duckdb

    texts = [form(t) for ts in OFFICIAL.values() for t in ts for form in FORMS.values()] + [None, "", "x"]
    docs = R.documents(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    mine = [tuple(r) for r in book.op1_license_sentences(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert mine == con.execute(licenses.scan_sql() + " ORDER BY doc_id").fetchall()
