"""funnelscope: company-website funnel audits over tables of captures, responses, reports and events."""
