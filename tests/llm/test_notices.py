"""Verbatim licence notices, wrapped and unwrapped."""

import textwrap

import pytest

from vetra.llm import license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
END = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; {2}\n\n{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
LATER = "either version {} of the License, or (at your option) any later version."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
BSD4 = BSD + """

3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the University of California, Berkeley and its contributors.

4. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
MORE = [
    *((BSD + BSD3.replace("the copyright holder", holder), "BSD-3-Clause") for holder in ("Google Inc.", "the University", "the Example Foundation, its parents", "Foo Bar GmbH & Co. KG")),
    (BSD + "\n\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"), (BSD4, "BSD-4-Clause"),
    (END.format("This library", "Lesser General Public License", LATER.format("2.1")), "LGPL-2.1-or-later"), (END.format("Foobar", "General Public License", LATER.format("3")), "GPL-3-or-later"),
    (END.format("This program", "Affero General Public License", LATER.format("3")), "AGPL-3-or-later"), (END.format("The Foo Bar tool", "General Public License", "version 2 of the License."), "GPL-2-only"),
    (END.format("Linux", "General Public License version 2", "").replace("; \n", ".\n"), "GPL-2-only"), (END.format("This library", "Library General Public License", LATER.format("2")), "LGPL-2-or-later"),
    (ISC, "ISC"), (ISC.split(", provided")[0] + ".", "0BSD"), (UNLICENSE, "Unlicense"), (EPL, "EPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Creative Commons Attribution-ShareAlike 4.0 International", "CC-BY-SA-4.0"), ("Licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License", "CC-BY-NC-ND-3.0"),
]
NOTICES = [(MIT, "MIT"), (APACHE, "Apache-2.0"), (APACHE.replace("\n\n", " "), "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3-or-later"), (GPL.format(";", ";", 2), "GPL-2-or-later"), (BSD, "BSD-2-Clause"), (BSD + BSD3, "BSD-3-Clause"), (MPL, "MPL-2.0"), *MORE]


@pytest.mark.parametrize(("text", "want"), NOTICES)
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [None, 30, 50, 72, 79])
def test_notice(text, want, mark, width):
    paragraphs = [textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False) if width else [p] for p in text.split("\n\n")]
    text = "\n".join(mark + line for p in paragraphs for line in [*p, ""])
    licenses, rest = license_scan.recognise(license_scan.scan("Some words before.\n\n" + text)[1])
    assert licenses == [want] and rest == []


def test_rest_of_notices_is_not_taken():
    assert license_scan.scan("This program is free software: you can redistribute it.\nMIT licences are nice") == (3, [])
    assert license_scan.scan("Subject to the terms of the Mozilla Public License, v. 2.0")[1] == []


@pytest.mark.parametrize(("text", "want"), [("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", ["GPL-2.0-only", "Linux-syscall-note", "BSD-3-Clause"]), ("# SPDX-License-Identifier: Apache-2.0 AND MIT\n\nReleased under the MIT License.", ["Apache-2.0", "MIT"])])
def test_tags(text, want):
    assert license_scan.recognise(license_scan.scan(text)[1]) == (want, [])


@pytest.mark.parametrize("text", [
    "The Google name may not be used.", "Redistribution and use in source and binary forms is fun.", "It is free software, they said; you can redistribute it.", "Creative Commons is an organisation.", "Attribution-ShareAlike 4.0", "ISC meets on Monday. Permission to use this room is granted.",
    "The unlicensed public domain. Eclipse of the sun, version 2.0", "SPDX-License-Identifier is a tag.", "Neither the name of the rose nor the names of its contributors", "licensed under the MIT", "GNU General Public License version 3",
])
def test_no_licences(text):
    assert license_scan.recognise(license_scan.scan(text)[1])[0] == []


def test_long_names_end():
    """A name has twelve words at most."""
    say = lambda n: f"Neither the name of {' '.join(f'n{k}' for k in range(n))} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert [license_scan.scan(say(n))[1] for n in (1, 12, 13)] == [[("BsdEndorse", "")], [("BsdEndorse", "")], []]
