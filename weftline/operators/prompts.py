"""Prompt texts as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weftline.functions.text import c, clip_bytes

VARIATIONS = ("claude", "gpt", "local", "generic")

# The texts of the prompts.
SYSTEM_LEAD = {"claude": "I need you to help with the following:\n\n", "gpt": "System: "}
EXAMPLES_LEAD = {"claude": "\n\nHere are some examples to help guide your response:\n\n"}
PROVIDERS = {"claude": "anthropic", "generic": "anthropic", "gpt": "openai", "local": "local"}
TRUNCATED = "<!-- HTML content truncated to fit context window -->"
EXTRACTION_SUFFIX = {
    "hierarchical": " Pay special attention to hierarchical relationships between elements.",
    "table": " Focus on extracting tabular data, preserving row and column relationships.",
}
EXTRACTION_STRUCTURE = {
    "multi_item": '[\n  {\n    "item1": "value1",\n    "item2": "value2",\n    // Additional fields as needed\n  },\n  // Additional items as needed\n]',
    "table": '[\n  {\n    "column1": "row1_value1",\n    "column2": "row1_value2",\n    // Additional columns as needed\n  },\n  // Additional rows as needed\n]',
    "hierarchical": '{\n  "parent1": {\n    "child1": "value1",\n    "child2": {\n      "grandchild1": "value2"\n    }\n  },\n  // Additional hierarchical data as needed\n}',
    "standard": '{\n  "field1": "value1",\n  "field2": "value2",\n  // Additional fields as needed\n}',
}
EXTRACTION_GUIDELINES = (
    "1. Be precise and accurate in your extraction", "2. Follow the exact structure requested", "3. Return null for any fields you cannot find")
EXTRACTION_MORE = {
    "hierarchical": ("4. Preserve parent-child relationships in the extracted data", "5. Ensure nested objects maintain their proper hierarchical structure"),
    "multi_item": ("4. Extract all matching items, not just the first one", "5. Ensure consistency in the structure across all extracted items"),
    "table": ("4. Preserve the tabular structure of the data", "5. Handle merged cells by duplicating values as appropriate", "6. Identify and use proper column headers"),
    "text_heavy": ("4. Preserve paragraph breaks and text formatting where relevant", "5. Extract complete sentences and maintain context"),
    "standard": ("4. Extract all relevant data as specified in the instruction",),
}
EXTRACTION_SPECIFIC = {
    "hierarchical": "Focus on correctly identifying parent-child relationships in the HTML structure. Pay attention to nested elements and how they relate to each other. Make sure the output maintains these hierarchical relationships.",
    "multi_item": "Extract all items that match the criteria, not just the first one. Each item should have consistent fields, even if some values are null. Make sure to identify repeating patterns in the HTML structure.",
    "table": "Extract the data as a table, preserving row and column relationships. Table headers should become field names. Handle merged cells by duplicating values across rows or columns as appropriate. Complex tables should maintain their structure.",
    "text_heavy": "Focus on extracting and preserving text content, including paragraph structure, formatting, and context. For long text, ensure you capture the complete content while maintaining its organization.",
}
NAVIGATION_SUFFIX = {
    "form_filling": " Focus on accurately filling out forms with the provided information.",
    "search_and_filter": " Focus on using search and filter controls to find specific content.",
    "checkout": " Focus on completing a checkout process with the provided information.",
    "data_extraction": " Focus on navigating to find specific data for extraction.",
}
NAVIGATION_GUIDELINES = (
    "1. Analyze the current page state and interactive elements", "2. Consider the objective and previous actions", "3. Determine the most appropriate next action",
    "4. Provide your reasoning for the chosen action")
NAVIGATION_MORE = {
    "form_filling": ("5. Focus on accurately filling form fields with the correct information", "6. Ensure all required fields are completed before submission"),
    "search_and_filter": ("5. Identify search and filter controls on the page", "6. Use specific search terms and filter options to narrow down results"),
    "checkout": ("5. Focus on completing each step of the checkout process", "6. Enter information accurately and verify details before final submission"),
    "data_extraction": ("5. Navigate to pages containing the required data", "6. Identify when the goal has been reached and data can be extracted"),
    "standard": ("5. Choose actions that make progress toward the objective", "6. Consider the most efficient path to achieve the goal"),
}
ACTION_FORMAT = (
    "Provide your reasoning in detail, then specify the exact action in this format:\n\n"
    "ACTION: [action type - click, input, select, scroll, wait, navigate, extract, complete]\nTARGET: [element index or description]\n"
    "VALUE: [any additional parameters needed]\n\nFor example:\nACTION: click\nTARGET: Element 3\nVALUE:\n\nOr:\nACTION: input\nTARGET: Element 5\n"
    "VALUE: search term\n\nOr:\nACTION: complete\nTARGET: task complete\nVALUE: objective achieved")
ANALYSIS_SUFFIX = {
    "main_content": " Focus on identifying the main content area of the page, distinguishing it from navigation, headers, footers, and sidebars.",
    "interactive_elements": " Focus on identifying all interactive elements on the page, such as buttons, links, inputs, and other controls.",
    "form_structure": " Focus on analyzing form structures, including field types, labels, required fields, and validation rules.",
    "table_structure": " Focus on analyzing table structures, including headers, data cells, and relationships between columns and rows.",
}
ANALYSIS_GUIDELINES = (
    "1. Analyze the DOM structure and organization", "2. Identify key components and their relationships", "3. Provide detailed insights about the page structure")
ANALYSIS_MORE = {
    "main_content": ("4. Identify the main content area of the page", "5. Distinguish main content from navigation, headers, footers, and sidebars", "6. Provide selectors that can be used to extract the main content"),
    "interactive_elements": ("4. Identify all interactive elements on the page", "5. Categorize elements by type (button, link, input, etc.)", "6. Provide selectors and details for each interactive element"),
    "form_structure": ("4. Analyze all forms on the page", "5. Identify field types, labels, required fields, and validation rules", "6. Map out the form submission process and any client-side validation"),
    "table_structure": ("4. Analyze all tables on the page", "5. Identify headers, data cells, and relationships between columns and rows", "6. Provide insights about the table structure and content organization"),
    "general_structure": ("4. Provide a comprehensive analysis of the page structure", "5. Identify key sections, content areas, and their relationships", "6. Include insights about the overall page organization and hierarchy"),
}
ANALYSIS_FORMAT = {
    "json": "Provide your analysis as a JSON object with the following structure:\n",
    "markdown": "Provide your analysis as a detailed Markdown document with sections for each major finding. Use headers, lists, and code blocks for structure and clarity.",
    "text": "Provide your analysis as a detailed plain text document with clear sections and formatting.",
}
#: The answer that each kind of analysis asks for.
ANALYSIS_STRUCTURE = {
    "main_content": """{
  "mainContentAreas": [
    {
      "description": "Primary article content",
      "selector": "article.main-content",
      "confidence": 0.95,
      "containsText": true,
      "containsImages": true
    }
  ],
  "otherContentAreas": [
    {
      "type": "navigation",
      "selector": "nav.main-nav",
      "position": "top"
    },
    // Other non-main content areas
  ],
  "recommendedExtractionSelector": "article.main-content"
}""",
    "interactive_elements": """{
  "interactiveElements": [
    {
      "type": "button",
      "text": "Submit",
      "selector": "button#submit",
      "purpose": "Form submission",
      "isEnabled": true,
      "position": {"x": 100, "y": 200}
    },
    // Other interactive elements
  ],
  "elementCategories": {
    "buttons": ["button#submit", "a.btn-primary"],
    "inputs": ["input#email", "input#password"],
    "links": ["a.nav-link", "a.footer-link"]
  },
  "primaryActionElements": ["button#submit", "a.cta-button"]
}""",
    "form_structure": """{
  "forms": [
    {
      "id": "login-form",
      "action": "/login",
      "method": "POST",
      "fields": [
        {
          "name": "email",
          "type": "email",
          "label": "Email Address",
          "required": true,
          "validationRules": ["email", "required"]
        },
        // Other form fields
      ],
      "submitButton": "button[type='submit']",
      "clientSideValidation": true
    }
  ],
  "requiredFields": ["input#email", "input#password"],
  "validationPatterns": {
    "email": "email format validation",
    "password": "minimum 8 characters"
  }
}""",
    "table_structure": """{
  "tables": [
    {
      "selector": "table.data-table",
      "headerRow": true,
      "columns": [
        {
          "index": 0,
          "name": "Product",
          "type": "string"
        },
        // Other columns
      ],
      "rowCount": 10,
      "columnCount": 4,
      "hasMergedCells": false
    }
  ],
  "tableRelationships": {
    "parentChild": ["table.parent-table", "table.child-table"],
    "related": ["table.prices", "table.inventory"]
  },
  "extractionSelectors": {
    "headers": "table.data-table > thead > tr > th",
    "rows": "table.data-table > tbody > tr",
    "cells": "table.data-table > tbody > tr > td"
  }
}""",
    "general_structure": """{
  "pageStructure": {
    "header": {
      "selector": "header",
      "components": ["logo", "navigation", "search"]
    },
    "mainContent": {
      "selector": "main",
      "components": ["article", "sidebar", "comments"]
    },
    "footer": {
      "selector": "footer",
      "components": ["links", "copyright", "social"]
    }
  },
  "contentAreas": [
    {
      "type": "main",
      "selector": "main article",
      "importance": "primary"
    },
    // Other content areas
  ],
  "navigation": {
    "primary": "nav.main-nav",
    "secondary": "nav.footer-nav",
    "breadcrumbs": "nav.breadcrumbs"
  },
  "interactiveAreas": [
    {
      "type": "form",
      "selector": "form#contact",
      "purpose": "Contact form"
    },
    // Other interactive areas
  ]
}""",
}
#: In this order; those with a lead get it, the others stand as they are.
PARTS = {
    "context": "Context:\n", "objective": "", "html": "HTML Content:\n```html\n", "elements": "", "instruction": "Instructions:\n", "guidelines": "",
    "format": "Output Format:\n", "schema": "Schema:\n```json\n", "examples": "", "type_specific": "", "action_format": "", "additional": "",
}


def _text(x: Column | str | None) -> Column:
    """A column, or the text itself."""
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def system_text(instruction: Column | str, variation: str) -> Column:
    return F.concat(F.lit(SYSTEM_LEAD.get(variation, "")), _text(instruction))


def example(input_: Column, output: Column, explanation: Column) -> Column:
    return F.concat(F.lit("Input:\n"), input_, F.lit("\n\nOutput:\n"), output, F.coalesce(F.concat(F.lit("\n\nExplanation:\n"), explanation), F.lit("")))


def examples_text(examples: Column, variation: str) -> Column:
    """From an array of structs (input, output, explanation); empty for none."""
    body = F.array_join(F.transform(examples, lambda e: example(e["input"], e["output"], e["explanation"])), "\n\n---\n\n")
    return F.when(F.size(examples) > 0, F.concat(F.lit(EXAMPLES_LEAD.get(variation, "\n\nExamples:\n\n")), body)).otherwise("")


def provider_of(variation: Column | str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv]), c(variation))


def truncate_html(html: Column | str, max_tokens: int = 8000) -> Column:
    """At most four bytes a token, cut after the last complete tag, open tags
    closed in reverse order."""
    limit = 4 * max_tokens
    text = c(html)
    cut = clip_bytes(text, limit)
    whole = F.regexp_extract(cut, r"(?s)^(.*>)", 1)
    tags = F.regexp_extract_all(whole, F.lit(r"<(/?[a-zA-Z][^\s/>]*)(?:[^>]*[^/>])?>"), F.lit(1))

    def step(stack: Column, tag: Column) -> Column:
        closing = tag.startswith("/")
        matches = (F.size(stack) > 0) & (F.element_at(stack, F.greatest(F.size(stack), F.lit(1))) == F.substring(tag, 2, 1000))
        return F.when(~closing, F.concat(stack, F.array(tag))).when(matches, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)

    open_ = F.aggregate(tags, F.expr("cast(array() as array<string>)"), step)
    closers = F.array_join(F.transform(F.reverse(open_), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")
    short = F.when(whole != "", F.concat(whole, closers, F.lit(f"\n{TRUNCATED}"))).otherwise(F.concat(cut, F.lit("<!-- HTML content truncated -->")))
    return F.when(F.octet_length(text) <= limit, text).otherwise(short)


def standard_prompt(system: Column | str, variation: str, **parts: Column | str | None) -> Column:
    """The parts that are given and not empty, under their leads."""
    out = [system_text(system, variation)]
    for name, lead in PARTS.items():
        if parts.get(name) is not None:
            value = _text(parts[name])
            tail = "\n```" if "```" in lead else ""
            out.append(F.when(value != "", F.concat(F.lit(lead), value, F.lit(tail))))
    return F.concat_ws("\n\n", *out)


def extraction(html: Column | str, instruction: Column | str, kind: str = "standard", schema: Column | None = None, variation: str = "claude",
               system: str = "", output: str = "json", examples: Column | None = None, context: Column | None = None, max_tokens: int = 8000) -> Column:
    structure = schema if schema is not None else F.lit(EXTRACTION_STRUCTURE.get(kind, EXTRACTION_STRUCTURE["standard"]))
    guide = "\n".join(EXTRACTION_GUIDELINES + EXTRACTION_MORE.get(kind, EXTRACTION_MORE["standard"]))
    wanted = f"Extract the requested information and return it as a valid {output} object with the following structure:\n"
    specific = EXTRACTION_SPECIFIC.get(kind)
    return standard_prompt(
        system + EXTRACTION_SUFFIX.get(kind, ""), variation, html=truncate_html(html, max_tokens), instruction=_text(instruction),
        format=F.concat(F.lit(wanted), structure), schema=schema, examples=None if examples is None else examples_text(examples, variation),
        context=None if context is None else F.concat(F.lit("Additional Context:\n"), context),
        type_specific=specific and f"Specific Instructions:\n{specific}", additional=f"Additional Guidelines:\n{guide}")


def elements_text(elements: Column) -> Column:
    """One line for each struct (index, tag, text, placeholder, id, classes,
    visible, x, y)."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    line = lambda e: F.format_string(
        "Element %d: %s - Text: '%s' - Placeholder: '%s' - ID: '%s' - Classes: [%s] - %s - Position: (x:%s, y:%s)\n", e["index"], e["tag"], blank(e["text"]),
        blank(e["placeholder"]), blank(e["id"]), F.array_join(e["classes"], ", "), F.when(e["visible"], "visible").otherwise("not visible"),
        e["x"].cast("string"), e["y"].cast("string"))
    return F.when(F.size(elements) > 0, F.concat(F.lit("Interactive elements on the page:\n\n"), F.array_join(F.transform(elements, line), ""))).otherwise(
        "No interactive elements identified on the page.")


def actions_text(actions: Column) -> Column:
    """One line for each struct (action_type, target, value, result)."""
    def line(a: Column, k: Column) -> Column:
        value = F.coalesce(F.concat(F.lit("with value '"), a["value"], F.lit("' ")), F.lit(""))
        result = F.when(F.coalesce(a["result"], F.lit("")) != "", F.concat(F.lit("- Result: "), a["result"])).otherwise("")
        return F.concat(F.format_string("Action %d: %s on target '%s' ", k + 1, a["action_type"], a["target"]), value, result, F.lit("\n"))

    return F.when(F.size(actions) > 0, F.concat(F.lit("Previous actions taken:\n\n"), F.array_join(F.transform(actions, line), ""))).otherwise(
        "No previous actions taken.")


def navigation(html: Column | str, objective: Column | str, elements: Column, actions: Column, kind: str = "standard", context: Column | None = None,
               url: Column | None = None, progress: Column | None = None, variation: str = "claude", system: str = "", max_tokens: int = 8000) -> Column:
    guide = "\n".join(NAVIGATION_GUIDELINES + NAVIGATION_MORE.get(kind, NAVIGATION_MORE["standard"]))
    where = F.concat_ws(
        "\n\n", *([F.concat(F.lit("Navigation Context:\n"), context)] if context is not None else []), actions_text(actions),
        *([F.concat(F.lit("Current URL: "), url)] if url is not None else []),
        *([F.format_string("Current progress: %d%%", F.floor(progress * 100).cast("long"))] if progress is not None else []))
    return standard_prompt(
        system + NAVIGATION_SUFFIX.get(kind, ""), variation, context=where, objective=F.concat(F.lit("Objective:\n"), _text(objective)),
        html=truncate_html(html, max_tokens), elements=elements_text(elements), guidelines=f"Guidelines:\n{guide}", action_format=ACTION_FORMAT)


def analysis(html: Column | str, objective: Column | str, kind: str = "general_structure", output: str = "json", variation: str = "claude",
             system: str = "", context: Column | None = None, max_tokens: int = 8000) -> Column:
    guide = "\n".join(ANALYSIS_GUIDELINES + ANALYSIS_MORE[kind])
    shape = ANALYSIS_STRUCTURE[kind]
    return standard_prompt(
        system + ANALYSIS_SUFFIX.get(kind, ""), variation, html=truncate_html(html, max_tokens),
        objective=F.concat(F.lit("Analysis Objective:\n"), _text(objective)), guidelines=f"Analysis Guidelines:\n{guide}",
        format=ANALYSIS_FORMAT[output] + (shape if output == "json" else ""),
        context=None if context is None else F.concat(F.lit("Additional Context:\n"), context))


def _quarter(x: Column | str | None) -> Column:
    return F.lit(0).cast("long") if x is None else F.coalesce(F.floor(F.octet_length(_text(x)) / 4), F.lit(0)).cast("long")


def extraction_tokens(html, instruction, system="", context=None, schema=None, examples: Column | None = None) -> Column:
    """Estimated size of the prompt: a quarter of the bytes of each part and 200."""
    parts = sum((_quarter(x) for x in (instruction, system, context, schema)), _quarter(html))
    if examples is not None:
        each = F.transform(examples, lambda e: F.floor(F.octet_length(example(e["input"], e["output"], e["explanation"])) / 4).cast("long"))
        parts = parts + F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)
    return parts + 200


def navigation_tokens(html, objective, system="", context=None, n_elements=0, n_actions=0) -> Column:
    number = lambda x: x if isinstance(x, Column) else F.lit(x)
    return sum((_quarter(x) for x in (objective, system, context)), _quarter(html)) + 50 * number(n_elements) + 50 * number(n_actions) + 300


def analysis_tokens(html, objective, system="", context=None) -> Column:
    return sum((_quarter(x) for x in (objective, system, context)), _quarter(html)) + 300
