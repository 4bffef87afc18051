"""The listing record."""

from __future__ import annotations

from pyspark.sql import types as T

#: The column order of the per-portal files; other columns follow by name.
CORE = ["Portal", "Barrio", "Tipo", "Titulo", "Precio", "Expensas", "Direccion", "Metros_Totales", "Metros_Cubiertos", "Ambientes", "Dormitorios", "Baños", "URL"]
EXTRA = ["Antiguedad", "Bajo_Precio", "Cocheras", "Descripcion_Breve", "Etiqueta_Destacado", "Fecha_Publicacion", "Inmobiliaria", "Porcentaje_Rebaja", "Visitas_Count", "Visto_Estado"]
COMMON = [c for c in CORE if c != "Metros_Totales"]
#: The columns that each portal has.
PORTAL_COLUMNS = {
    "zonaprop": [*COMMON, "Metros_Totales", "Cocheras", "Bajo_Precio", "Porcentaje_Rebaja", "Etiqueta_Destacado"],
    "argenprop": [*COMMON, "Descripcion_Breve", "Antiguedad", "Visto_Estado", "Visitas_Count"],
    "cabaprop": [*COMMON, "Metros_Totales", "Inmobiliaria", "Fecha_Publicacion"],
}
#: Columns that become whole numbers.
NUMERIC = ["Expensas", "Ambientes", "Dormitorios", "Baños", "Cocheras", "Metros_Cubiertos", "Metros_Totales", "Visitas_Count"]

LISTING = T.StructType([T.StructField(c, T.BooleanType() if c == "Bajo_Precio" else T.StringType()) for c in CORE + EXTRA])
PAGES = "portal string, barrio string, tipo string, page_no int, seq long, html string"
