"""Dependency categories and other lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What packages are, in the order in which it is asked.
PREFIXES = {
    "types": ["@types/"],
    "devTooling": ["eslint-", "@eslint/", "prettier-", "@prettier/"],
    "testing": ["jest", "@jest/", "playwright", "@playwright"],
    "styling": ["postcss-", "@postcss/", "stylelint-", "@stylelint/", "@emotion/"],
}
NAMES = {
    "testing": [
        "jest", "vitest", "mocha", "chai", "jasmine", "@testing-library/react", "cypress", "playwright", "@playwright/test", "pytest", "pytest-cov",
        "unittest2", "nose", "tox",
    ],
    "framework": [
        "react", "vue", "@angular/core", "svelte", "solid-js", "preact", "next", "express", "fastify", "koa", "nestjs", "@nestjs/core", "fastapi", "flask",
        "django", "celery", "starlette", "uvicorn",
    ],
    "library": [
        "axios", "node-fetch", "got", "superagent", "ky", "undici", "requests", "httpx", "aiohttp", "urllib3", "zod", "joi", "yup", "ajv", "class-validator",
        "pydantic", "cerberus", "marshmallow", "jsonschema",
    ],
    "uiComponent": [
        "@radix-ui/react-popover", "@radix-ui/react-switch", "@radix-ui/react-tabs", "@radix-ui/react-dialog", "@radix-ui/react-dropdown-menu",
        "@radix-ui/react-tooltip", "@radix-ui/themes", "@headlessui/react", "@mui/material", "@mui/joy", "@chakra-ui/react", "antd", "react-bootstrap",
        "reactstrap", "semantic-ui-react",
    ],
    "database": [
        "pg", "pg-promise", "mysql", "mysql2", "mongoose", "mongodb", "sequelize", "prisma", "@prisma/client", "knex", "typeorm", "redis", "ioredis",
        "sqlite3", "better-sqlite3", "sqlalchemy", "psycopg2", "psycopg2-binary", "pymongo", "redis-py", "asyncpg",
    ],
    "devTooling": [
        "eslint", "prettier", "black", "ruff", "mypy", "flake8", "pylint", "isort", "lint-staged", "setuptools", "poetry", "wheel", "pip-tools",
    ],
    "vcs": [
        "simple-git", "isomorphic-git", "nodegit", "dugite", "husky", "gitpython", "dulwich", "pygit2",
    ],
    "cli": [
        "commander", "yargs", "cac", "meow", "inquirer", "prompts", "click", "typer", "docopt", "fire",
    ],
    "compiler": [
        "webpack", "vite", "babel", "@babel/core", "rollup", "esbuild", "typescript", "tsx", "ts-node", "swc", "@swc/core", "parcel",
    ],
    "dataViz": [
        "chart.js", "react-chartjs-2", "recharts", "d3", "victory", "nivo", "@nivo/core", "echarts", "apexcharts", "highcharts", "plotly.js", "vega",
        "vega-lite", "@visx/visx", "matplotlib", "seaborn", "plotly", "bokeh", "altair", "pygal", "plotnine",
    ],
    "styling": [
        "tailwindcss", "@tailwindcss/postcss", "@tailwindcss/vite", "sass", "node-sass", "less", "postcss", "autoprefixer", "stylelint", "styled-components",
        "emotion", "stylis", "windicss", "unocss", "bootstrap", "bulma", "csso", "cssnano", "purgecss",
    ],
}
CHART_TERMS = ["chart", "charting", "graph", "graphing", "plot", "plotting", "visualization", "visualisation", "dataviz"]

# Kinds of entry points in words, and responsibilities of areas that aren't primary.
ENTRY_LABELS = {
    "bootstrap": "Application bootstrap entry point",
    "cli": "Command-line entry point",
    "runtime": "Conventional runtime entry point",
    "library": "Package's declared public entry point",
    "public-export": "Public export entry point",
    "framework": "Framework entry point",
    "test": "Test entry point",
    "route": "Next.js route entry point",
    "http-handler": "HTTP route handler entry point",
    "server-action": "Server Action entry point",
    "middleware": "Middleware entry point",
    "ui-event": "UI event entry point",
}
NON_PRIMARY = ["Tests", "Test fixtures/support data", "Build/tooling configuration"]


def dependency_category(name: Column, description: Column | None = None, keywords: Column | None = None) -> Column:
    """One of 13 categories: by prefix, a 'cli' word, exact name, then words of description and keywords; else 'other'."""
    low = F.lower(name)
    terms = r"(?i)\b(" + "|".join(CHART_TERMS) + r")\b"
    signal = F.lit(False)
    if description is not None:
        signal = F.coalesce(description.rlike(terms), F.lit(False))
    if keywords is not None:
        signal = signal | F.coalesce(F.exists(keywords, lambda k: k.rlike(terms)), F.lit(False))
    rules = [(c, low.rlike("^(" + "|".join(p) + ")")) for c, p in PREFIXES.items()]
    rules += [("cli", low.rlike(r"\bcli\b"))]
    rules += [(c, low.isin(*names)) for c, names in NAMES.items()]
    out = F.when(signal, F.lit("dataViz")).otherwise(F.lit("other"))
    for category, rule in reversed(rules):
        out = F.when(rule, F.lit(category)).otherwise(out)
    return out


def system_class(responsibility: Column) -> Column:
    return (
        F.when(responsibility.isin("Tests", "Test fixtures/support data"), F.lit("Tests / test support"))
        .when(responsibility == "Build/tooling configuration", F.lit("Build/tooling configuration"))
        .otherwise(F.lit("Implementation area"))
    )


def entry_label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ENTRY_LABELS.items() for x in kv])[kind]
