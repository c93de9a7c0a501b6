"""Fixed values of the license scan: phrases that name a license, and wordings with optional and replaceable regions.

In a wording ``<<beginOptional>>`` ... ``<<endOptional>>`` encloses words that may be missing as a
whole, and ``<<var;name=...;match=lo,hi>>`` stands for lo to hi words of any kind. All other words are mandatory.
The wordings are the public ones of the licenses and of their usual notices.
"""

#: Words that stand consecutively, and the label that they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name=holder;match=1,12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>
"""

_ISC = """
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
"""

_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.
"""

_BSD_3 = _BSD + """
<<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organisation;match=1,12>> nor the names of its contributors may
be used to endorse or promote products derived from this software without specific prior written permission.
"""

_APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at <<var;name=place;match=1,12>> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied.
"""

_GPL = """
This program is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
<<var;name=kind;match=0,2>> General Public License as published by the Free Software Foundation<<beginOptional>>; either version
<<var;name=version;match=1,2>> of the License, or (at your option) any later version<<endOptional>>.
"""

_MPL = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at <<var;name=place;match=1,8>>
"""

_UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.
"""

#: (label, wording).
WORDINGS = [
    ("mit", _MIT),
    ("mit", "released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("isc", _ISC),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", _BSD_3),
    ("apache-2.0", _APACHE),
    ("apache-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License, <<beginOptional>>Version<<endOptional>> 2.0"),
    ("gpl", _GPL),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>version<<endOptional>> 3"),
    ("gpl-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, <<beginOptional>>version<<endOptional>> 2"),
    ("mpl-2.0", _MPL),
    ("unlicense", _UNLICENSE),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-nc-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY-NC-SA 4.0"),
    ("cc-by", "Creative Commons Attribution <<var;name=version;match=0,2>> International License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike <<var;name=version;match=0,2>> International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial <<var;name=version;match=0,2>> International License"),
]
