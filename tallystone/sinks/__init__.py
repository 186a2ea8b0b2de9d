"""Reports of collected rows and what renders them: JSON, CSV, console, Markdown, HTML, OpenMetrics, badges, SARIF."""
