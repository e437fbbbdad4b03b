"""Charsets, and TypeScript with strings, templates and comments that look like code."""

import pytest

from lodeline.sources import parse

TEXTS = {
    "shift_jis": "設定ファイルを読み込み、結果をログに出力します。エラーの場合は終了する。", "euc_jp": "これはテストのための日本語の文章です。変数の値を確認してください。",
    "cp949": "이 함수는 설정 파일을 읽고 결과를 반환합니다. 오류가 발생하면 종료합니다.", "gb18030": "这个函数读取配置文件并返回结果。如果发生错误则退出程序。", "big5": "這個函數讀取設定檔並傳回結果。如果發生錯誤則結束程式。",
    "cp1251": "Эта функция читает файл настроек и возвращает результат. При ошибке работа завершается.", "koi8_r": "Эта функция читает файл настроек и возвращает результат. При ошибке работа завершается.",
    "cp1252": "Die Prüfung läuft über größere Flächen, señor; déjà vu à côté.",
}


@pytest.mark.parametrize("code", TEXTS)
def test_charsets(code):
    for text in (TEXTS[code], f"# {TEXTS[code]}\nx = 1\n" * 20):
        assert parse.decoded(text.encode(code)) == text
    assert parse.decoded(TEXTS[code].encode()) == TEXTS[code]


def test_noise_is_no_text():
    assert parse.decoded(bytes(range(128, 256)) * 10) is None and parse.decoded(b"\1\2\3\x81" * 300) is None


CODE = """
import { a } from './a'; // import { no } from './commented';
/* export class Commented { } */
const help = `usage:
export class InTemplate { run() {} }
import x from './nowhere';
${format(`nested } ${inner({ a: 1 })} {`)} }`;
export class Real extends Base<string> {
  brace = "}"; other = '{ not("a call") }';
  re = /[}"']+\\/\\{/g;
  url: string = 'https://x.org/a;b,c'; // } not here
  run(text: string = ")") { return go(`${text} } ${call(1)} {`) + "skip(this)"; }
  last(): number { return 1 / half(2) / 3; }
}
export function after(a: string): string { return "}" + done(a) }
"""


def test_strings_templates_and_comments_of_typescript():
    found = parse.parse_typescript("a.ts", CODE)
    assert found["imports"] == ["./a"] and found["exports"] == ["Real", "after"]
    real, after = found["entities"]
    assert (real["name"], real["parent_classes"], [m["name"] for m in real["methods"]]) == ("Real", ["Base"], ["run", "last"])
    fields = {f["name"]: (f["type"], f["default"]) for f in real["fields"]}
    assert fields["brace"] == (None, '"}"') and fields["other"] == (None, "'{ not(\"a call\") }'") and fields["url"] == ("string", "'https://x.org/a;b,c'")
    assert {"go", "call", "half"} <= {*real["called_entities"]} and not {"not", "skip", "done"} & {*real["called_entities"]}
    assert after["called_entities"] == ["done"] and after["outputs"] == "string"


def test_hidden_texts_keep_their_length():
    for text in (CODE, "`${", "'abc", "/* open", "a / b / c", "`a${`b${c}`}`", "x = /re\\/[/]/; y = '\\''", "}{`", ""):
        hidden = parse._hidden(text)
        assert len(hidden) == len(text)
    assert parse._shown(parse._hidden("f('a{b}', `c;${d}`)")) == "f('a{b}', `c;${d}`)"
