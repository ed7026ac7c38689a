import pytest
from helpers import awkward, docs

from threadtox.llm import licenses

CASES = [
    ("Text.\nReleased under the MIT License.", "mit", "MIT", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", "GPL-3.0", 0),
    ("Licensed under the Apache Licence,  Version 2.0.", "apache-2", "Apache-2.0", 0),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", "CC-BY-NC-4.0", 0),
    ("# under the terms of the GNU General Public License, version 2; or (at your option) any later version of the license.", "gpl-2,or-later", "GPL-2.0-or-later", 0),
    ("Permission is hereby granted, free of charge, to any person. The above copyright notice and this permission notice shall be included. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.", "free-permission,keep-notice,no-warranty", "MIT", 0),
    ("Redistribution and use in source and binary forms are permitted:\n Redistributions of source code must retain this.\n"
     "Redistributions in binary form must reproduce it.\nNeither the name of X may be used to endorse it; no licence.", "bsd-grant,bsd-source,bsd-binary,bsd-name", "BSD-3-Clause", 0),
    ("Released under the MIT License. More text. Licensed under CC BY-NC 4.0. Released under the MIT license.", "mit,cc-by-nc-4.0,mit", "MIT,CC-BY-NC-4.0", 0),
    ("All rights reserved. It comes without any warranty.", "all-rights,no-warranty", "", 2),
    ("I lost my driving licence. He gave permission.", "", "", 0),
    ("SPDX-License-Identifier: Apache-2.0", "spdx:apache-2.0", "Apache-2.0", 0),
]


def result(df):
    return [(r.doc_id, r.sentence_ids, r.licenses, r.n_unmatched) for r in df.collect()]


def test_sentences_and_rules(spark):
    got = result(licenses.scan(docs(spark, [(i, c[0]) for i, c in enumerate(CASES)], extra=True)))
    assert got == [(i, *c[1:]) for i, c in enumerate(CASES)]


def test_rules_are_ordered(spark):
    text = "A license one. A license two. A license one."
    known = [("x", "license one"), ("y", "license two")]
    df = docs(spark, [(1, text)])
    assert result(licenses.scan(df, known, [(("x", "y"), "XY"), (("x",), "X")])) == [(1, "x,y,x", "XY,X", 0)]
    assert result(licenses.scan(df, known, [(("x",), "X"), (("x", "y"), "XY")])) == [(1, "x,y,x", "X", 1)]
    assert result(licenses.scan(df, known, [])) == [(1, "x,y,x", "", 3)]


@pytest.mark.parametrize("repeat", [1, 20_000])
def test_awkward_rows(spark, repeat):
    rows = [*awkward(), (40, "Words of prose. " * repeat + "Released under the MIT License.")]
    got = result(licenses.scan(docs(spark, rows, extra=True)))
    assert got == [(r[0], "", "", 0) for r in rows[:-1]] + [(40, "mit", "MIT", 0)]
    assert licenses.scan(docs(spark, [])).count() == 0


def test_no_sentence_needs_a_hint(spark):
    texts = [("Creative Commons Attribution 4.0 International", "cc-by-4.0"), ("Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
             ("Attribution-NonCommercial 4.0", "cc-by-nc-4.0"), ("All  rights   reserved", "all-rights"), ("It is in the *public*  domain", "public-domain"),
             ('It is provided "as is"', "no-warranty"), ("The above  copyright\tnotice shall be included", "keep-notice")]
    got = result(licenses.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(texts)])))
    assert [r[1] for r in got] == [x for _, x in texts]


BSD = """Copyright (c) 2020, X
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """%sThis program is free software: you can redistribute it and/or modify
%sit under the terms of the GNU %sGeneral Public License as published by
%sthe Free Software Foundation%s either version %s of the License, or
%s(at your option) any later version.
"""
WRAPPED = [
    (BSD, "BSD-3-Clause"), (BSD.replace("\n", "\r\n"), "BSD-3-Clause"), ("\n".join(" * " + x for x in BSD.split("\n")), "BSD-3-Clause"),
    (GPL % ("", "", "", "", ",", "3", ""), "GPL-3.0-or-later"), (GPL % ("# ", "# ", "", "# ", ";", "2", "# "), "GPL-2.0-or-later"),
    (GPL % (" * ", " * ", "Lesser ", " * ", ";", "2.1", " * "), "LGPL-2.1-or-later"),
    ("GNU General Public License, version 3, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("Under the GNU General Public License, version\n3. It ends.", "GPL-3.0"),
    ("Released under the\nMIT\nLicense or the Apache License,\nVersion 2.0", "MIT,Apache-2.0"),
    ("Copyright (c) X\nPermission is hereby granted, free of\ncharge, to any person.\n\nThe above copyright notice\nshall be included.", "MIT"),
]


def test_wrapped_licence_texts(spark):
    got = result(licenses.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(WRAPPED)])))
    assert [r[2] for r in got] == [x for _, x in WRAPPED]


#: Licence notices as they stand in files, and what they are; nothing else may be found.
NOTICES = [
    ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC-BY-SA-3.0"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "CC-BY-NC-ND-4.0"), ("CC-BY-4.0", "CC-BY-4.0"),
    ("under a Creative Commons Attribution 2.5 License", "CC-BY-2.5"), ("Attribution-NonCommercial-ShareAlike 1.0", "CC-BY-NC-SA-1.0"), ("cc by-nd 2.0", "CC-BY-ND-2.0"),
    ("This program is made available under the terms of the Eclipse Public License 2.0", "EPL-2.0"), ("Eclipse Public License - v 1.0", "EPL-1.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("// SPDX-License-Identifier: LGPL-2.1-or-later\n#include <x.h>", "LGPL-2.1-or-later"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0"), ("SPDX-License-Identifier: GPL-3.0-only OR MIT", "GPL-3.0,MIT"),
    ("SPDX-License-Identifier: (Apache-2.0 AND CC-BY-4.0)", "Apache-2.0,CC-BY-4.0"), ("SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\n"
     "copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"", "ISC"),
    ("The MIT License (MIT)\n\nCopyright (c) 2015 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy. The above copyright notice and this\n"
     "permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND", "MIT"),
    ("The MIT License (MIT)", "MIT"), ("Boost Software License - Version 1.0 - August 17th, 2003", "BSL-1.0"),
    ("under the terms of the GNU Free Documentation License, Version 1.2\nor any later version published by the Free Software Foundation", "GFDL-1.2-or-later"),
    ("GNU Free Documentation License, Version 1.3", "GFDL-1.3"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "Zlib"),
    ("Mozilla Public License, v. 2.0", "MPL-2.0"), ("Licensed under the 3-clause BSD license", "BSD-3-Clause"), ("Artistic License 2.0", "Artistic-2.0"),
]
#: Texts about licences that grant none.
NO_LICENCE = [
    "This is not licensed under the MIT License.", "The code is no longer distributed under the GNU General Public License, version 2.", "It was never released under CC BY 4.0.",
    "He lost his driving licence in the eclipse.", "The public library gave permission to print the software catalogue.", "Attribution 4 of the text is doubtful.",
    "Account by account, 4.0 in all.", "The general public has a right to know, said the foundation.",
]


def test_notices_and_texts_without_licence(spark):
    """Precision and recall over these notices are 1: each gives its licences, the other texts none."""
    rows = [(i, t) for i, t in enumerate([t for t, _ in NOTICES] + NO_LICENCE)]
    got = [r[2] for r in result(licenses.scan(docs(spark, rows)))]
    assert got == [x for _, x in NOTICES] + [""] * len(NO_LICENCE)


def test_every_known_sentence_passes_the_word_test():
    """Every notice that gives a licence has a word that the patterns need; the test reads the tables, not a list of its own."""
    import re
    words = re.compile(licenses.needed([p for _, p in licenses.SENTENCES] + [s for s, _ in licenses.EXACT] + ["spdx"]))
    texts = [t for t, _ in NOTICES + WRAPPED] + [c[0] for c in CASES if c[1]] + [s for s, _ in licenses.EXACT]
    assert all(words.search(t.lower()) for t in texts)
    assert licenses.needed(["[0-9]+ x?"]) == "" and licenses.needed(["(a big|some) green[ -]dog", "licen[cs]e"]) == "green|licen"


def test_the_scan_equals_its_sql_on_all_notices(spark, tmp_path):
    import duckdb

    from threadtox.llm.queries import ORACLE_SQL
    texts = [t for t, _ in NOTICES + WRAPPED] + NO_LICENCE + [c[0] for c in CASES] + [None, "", " \n\n", "a\x01b"]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL["op6_license_scan"]).fetchall()
    got = licenses.scan(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
