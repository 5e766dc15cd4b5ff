"""Small repositories of text for the tests of extraction."""

APP = {
    "package.json": '{"name": "shop", "scripts": {"test": "vitest run", "build": {"cmd": "tsc"}}, "dependencies": {"react": "^19.0.0", "@tauri-apps/api": "2"}, "devDependencies": {"vitest": "3"}, "bin": {"shop": "dist/cli.js"}}',
    "broken/package.json": "{not json",
    "Cargo.toml": '[package]\nname = "shop-core" # the crate\n\n[dependencies]\nserde = "1" \n"quoted" = { version = "2" }\ntauri = "2"\n[features]\ndefault = ["a#b"]\n[[bin]]\nname = "one"\npath = "src/one.rs"\n[[bin]]\nname = "two"\n',
    "README.md": "# Shop\n\nRuns `placeOrder` from src/orders.ts.\n\n## Usage\n\n```sh\n$ npm run build\nnpm test\n# Not a comment here\n```\n\nnpm install is a sentence.\ncargo build\n\n### Routes\nGET /api/orders and /api/items/{id}\n\n## Usage\nSee src/view.tsx\n",
    "tsconfig.json": "{}",
    "src/util/money.ts": 'export interface Money { cents: number }\nexport type Rate = number;\nexport function round(m: Money): Money {\n  return { cents: Math.round(m.cents) };\n}\nexport default class Purse {\n  total = 0;\n  /* a comment with { a brace */\n  add(m: Money): void {\n    this.check(m);\n    this.total += m.cents; // ) }\n  }\n  private check(m: Money) {\n    if (m.cents < 0) throw new Error("negative {");\n  }\n}\n',
    "src/orders.ts": 'import { round, type Money } from "./util/money.js";\nimport Purse from "./util/money";\nimport * as money from "./util/money";\nimport { readFile } from "node:fs/promises";\nimport {\n  useState,\n} from "react";\nimport missing from "./nowhere";\nimport { invoke } from "@tauri-apps/api/core";\nimport { listen, emit } from "@tauri-apps/api/event";\n\nexport const placeOrder = async (m: Money) => {\n  const purse = new Purse();\n  helper(round(m));\n  money.round(m);\n  list.map(m);\n  await invoke("place_order", { m });\n  await invoke<string>("no_such_command");\n  emit("order-sent");\n  fetch("/api/orders");\n};\n\nfunction helper(m: Money) {\n  unknownCall(m);\n  listen<string>("order-done", () => {});\n  const text = "placeOrder(1)";\n}\n',
    "src/view.tsx": 'import { placeOrder } from "./orders";\n\nexport function OrderView() {\n  return (\n    <div>\n      <OrderRow onPick={placeOrder} onDrop={nothingSuch} />\n      <Lost.Thing />\n    </div>\n  );\n}\n\nexport const OrderRow = () => <span>row</span>;\n',
    "tests/orders.test.ts": 'import { describe, it } from "vitest";\nimport { placeOrder } from "../src/orders";\ndescribe("orders", () => {\n  it("placeOrder works", () => {});\n});\n',
    "src/view.test.tsx": "const nothing = 1;\n",
    "src-tauri/tauri.conf.json": '{"productName": "Shop", "app": {"windows": [{"title": "x"}], "security": {"csp": "default-src"}}, "build": {"frontendDist": "src/orders.ts"}, "bundle": "src/orders.ts"}',
    "src-tauri/capabilities/main.json": '{"identifier": "main", "windows": ["main"], "permissions": ["core:default", "allow-place_order", {"identifier": "fs:read"}]}',
    "src-tauri/src/main.rs": 'mod commands;\nmod events;\nuse crate::commands::{place_order, cancel as undo};\n\nfn main() {\n    tauri::Builder::default()\n        .invoke_handler(tauri::generate_handler![\n            commands::place_order,\n            commands::ghost\n        ]);\n    undo(1);\n    setup();\n}\n\nfn setup() {\n    commands::cancel(2);\n    elsewhere();\n}\n',
    "src-tauri/src/commands.rs": 'use crate::events::ORDER_DONE;\nuse super::store::Store;\n\n#[tauri::command]\n#[allow(unused)]\npub async fn place_order(app: App, store: Store) -> Result<(), String> {\n    let id = store.save(1);\n    let fresh = Store::new();\n    fresh.save(2);\n    app.emit(ORDER_DONE, id);\n    app.emit("literal-event", 1);\n    app.emit(unknown_name, 1);\n    Ok(())\n}\n\n#[tauri::command]\npub fn cancel(id: u32) {\n    let _brace = "}";\n}\n',
    "src-tauri/src/events.rs": 'pub const BASE: &str = "order-done";\npub const ORDER_DONE: &str = BASE;\n',
    "src-tauri/src/store.rs": 'pub struct Store {\n    n: u32,\n}\n\nimpl Store {\n    pub fn new() -> Self {\n        Self::blank()\n    }\n    fn blank() -> Self {\n        Store { n: 0 }\n    }\n    pub fn save(&self, id: u32) -> u32 {\n        self.check(id);\n        unique_helper(id)\n    }\n    fn check(&self, id: u32) {}\n}\n\npub trait Keep {\n    fn keep(&self);\n}\n\nmod inner {\n    use super::*;\n    pub fn unique_helper(x: u32) -> u32 { x }\n    #[test]\n    fn it_saves() {}\n}\n',
    "src-tauri/src/bad.rs": "fn open( {\n",
    "node_modules/x/index.ts": "export function ignored() {}\n",
}
